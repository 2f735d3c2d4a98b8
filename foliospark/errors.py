"""Errors as data: every expected failure is a code with the message shown to users; the job goes on."""

from __future__ import annotations

from dataclasses import dataclass

# User messages of the error codes.
MESSAGES = {
    "unsupported_format": "不支援的檔案格式。",
    "corrupted": "檔案已損壞或無法開啟。",
    "too_large": "檔案超過大小上限。",
    "empty": "檔案是空的（0 KB）。",
    "ocr_unavailable": "OCR 引擎尚未安裝或載入失敗，掃描文件與圖片暫時無法辨識。數位 PDF 與 Office 文件仍可正常處理。",
    "model_missing": "找不到離線模型檔，請確認 models/ 目錄已放入模型。",
    "password": "檔案有密碼保護，請先解除密碼後再上傳。",
    "dependency_missing": "處理時發生未預期錯誤，已記錄技術細節。",
    "unexpected": "處理時發生未預期錯誤，已記錄技術細節。",
    "out_of_memory": "記憶體不足，此檔案已跳過。請關閉其他程式或分批處理。",
}
MSG_READER_MISSING = "讀取 Outlook .msg 需要安裝 extract-msg 套件。"


def too_large_message(size_mb: float, limit_mb: float) -> str:
    return f"檔案過大（{size_mb:.1f} MB，上限 {limit_mb} MB）。"


@dataclass
class DocumentError(Exception):
    """Raised inside adapters only; they turn it into the error columns of the row."""

    code: str
    detail: str = ""
    message: str | None = None

    def __post_init__(self) -> None:
        self.user_message = self.message or MESSAGES[self.code]
        super().__init__(self.user_message, self.detail)
