"""Curated terms of the subjects, in both languages, for review by people.

Chinese terms match anywhere; English terms match whole words and their plural, those that end in
``-`` any word that begins so. Weights are not kept here: they are fitted on labelled samples
(``subjects.fit``), so that a term of little use there counts little. A subject without an entry is
known by the words of its titles and scope note alone.
"""

from __future__ import annotations

#: Terms in Chinese, parted by blanks, and in English, parted by commas.
CURATED: dict[str, tuple[str, str]] = {
    "law": (
        """法律 法院 法庭 法官 律師 律師信函 原告 被告 證人 證詞 代理人 仲裁人 公證人 公證 仲裁 調解 和解 訴訟 訴狀 民事 刑事 上訴 起訴 抗辯 聲請 裁定 判決書 駁回 扣押 強制執行
        提起 送達 閱卷 筆錄 管轄 委任狀 存證信函 契約 條款 租約 簽署 修訂 終止 撤回 義務 連帶保證 保密義務 違約金 賠償 損害 著作權 法務""",
        """law, lawsuit, lawyer, court of law, judge, tribunal, counsel, attorney, claimant, plaintiff, defendant, respondent, arbitrator, arbitration, notary, notaris-, affidavit, deposition,
        testimony, witness, hearing, verdict, appeal-, statut-, jurisdiction-, injunction, indemnity, liability, breach-, clause, covenant, contractual, lease, litigat-, enforce-, dismissed,
        adjourn-, ratified, upheld, waive-, amended, contested, disputed, void, voided, binding, civil, procedural, motion, warranty, power of attorney, settlement""",
    ),
    "finance": (
        """財務 財務長 財務報表 理財專員 會計 會計師 會計科目 出納 查帳員 投資 投資人 投資組合 證券 債券 基金 股利 利率 匯率 折舊 攤提 預算 結算 授信 擔保品 質押 貸款 撥款 應收帳款
        現金流量 現金 資產負債表 負債 淨值 毛利 準備金 營業稅 報銷 沖銷 核銷 編列 申報 查核 餘額 費用 金庫 櫃檯""",
        """financ-, fiscal, accountant, accounting, auditor, audit-, broker, cashier, controller, treasurer, treasury, accru-, amortis-, booked, budget, cash, collateral, consolidated, credit-,
        credit line, deferred, depreciation, dividend, equity, expense, expense claim, forecast, hedg-, interest, interest rate, invest-, invoice, ledger, liquid, liquidity, mortgage, overdue,
        portfolio, quarterly, receivable, reconcil-, refund-, reserve, balance sheet, tax, taxable, tax return, written off, loan, currency, bond, shareholder""",
    ),
    "medicine": (
        """醫療 醫師 護理 護理師 藥師 治療師 放射師 病患 病房 病歷 門診 急診 診間 開刀房 手術 開刀 麻醉 縫合 住院 出院 出院摘要 轉診 診斷 切片 切片檢查 心電圖 血壓 發燒 感染 過敏
        症狀 抗生素 胰島素 疫苗 施打 輸血 劑量 用藥 藥劑 處方 開立 療程 治療 復健 照護 家屬 監測 追蹤""",
        """medic-, clinic-, physician, surgeon, nurse, nursing, pharmacist, radiologist, therapist, patient, ward, surg-, acute, chronic, benign, fever, feverish, allerg-, antibiotic, insulin,
        vaccin-, transfus-, dosage, prescri-, diagnos-, symptom, infection, artery, blood, blood pressure, biops-, radiograph, rehabilitat-, therap-, discharge-, sedat-, sutur-, screened,
        operated, monitored, treated, operating room""",
    ),
    "software": (
        """軟體 程式 程式碼 原始碼 指令碼 病毒碼 應用程式 修補程式 修補 伺服器 主機 端點 雲端 機房 資料庫 快取 記憶體 執行緒 容器 映像 介面 防火牆 加密 金鑰 系統 系統管理員 架構師
        工程師 開發 開發團隊 測試 測試人員 測試環境 單元測試 值班人員 版本 發行版本 建置 部署 上線 重構 編譯 除錯 合併 回復 備份 排程 查詢語法 記錄檔""",
        """software, developer, programmer, administrator, architect, maintainer, tester, engineer on call, on-call, server, data centre, database, cache-, compil-, debug-, deploy-, deprecat-,
        encrypt-, endpoint, firewall, interface, memory, memory leak, thread, unit test, regression, release, repository, branch, build, pipeline, patch-, refactor-, merged, modular, query,
        scalable, script, bug, buggy, log file, logged, backup, container, asynchronous, open-source, indexed, virus, rolled back""",
    ),
    "science": (
        """科學 研究員 化學家 物理學者 天文學者 生物學者 實驗助理 實驗 實驗室 實驗數據 無塵室 觀測站 觀測 假說 理論 細胞 晶體 基因 酵素 催化劑 溶劑 同位素 化學反應 粒子 軌道 光譜
        波長 磁場 望遠鏡 顯微鏡 沉積物 標本 氣候模型 量測 量測誤差 採樣 合成 定序 溶解 照射 模擬 校正 重現""",
        """scien-, researcher, physicist, chemist, biologist, astronomer, lab, lab technician, laborator-, experiment-, hypothes-, theor-, empirical, measurement, measured, observatory, specimen,
        sampl-, cell, crystal, genetic, genome, enzyme, catalyst, solvent, isotope, particle, orbit, spectr-, wavelength, magnetic, magnetic field, telescope, microscope, sediment, climate model,
        reaction, calibrat-, dissolv-, irradiat-, replicat-, sequenc-, simulat-, synthesi-, titrat-, observed, aqueous, molecular, quantum, thermal""",
    ),
    "sport": (
        """運動 教練 裁判 裁判判決 選手 隊長 守門員 前鋒 球迷 球衣 球拍 球場 比賽 準決賽 決賽 冠軍 聯賽 錦標賽 賽季 接力賽 馬拉松 短跑 衝刺 計分板 獎牌 罰球 得分 奪冠 晉級 擊敗
        替補 轉會 選拔 集訓 訓練 熱身 更衣室 田徑 體育""",
        """sport, athlet-, coach-, captain, goalkeeper, striker, physio, referee, jersey, racket, medal, marathon, sprint-, relay, match, league, championship, tournament, semi-final, season,
        seasonal, stadium, pitch, scoreboard, penalty kick, offside, tackl-, training, training camp, trained, benched, drafted, defeated, qualified, relegated, scored, substituted, injured,
        unbeaten, victorious, competitive, transfer, warm-up, cheered""",
    ),
    "education": (
        """教育 教學 教學大綱 教務 教務主任 校長 教師 教室 教科書 導師 講師 講座 學生 幼兒園 校園 校外教學 圖書館 禮堂 宿舍 課程 課程綱要 備課 授課 作業 期末考 補考 論文 成績單
        學分 選修 學期 學費 獎學金 招生 註冊 評量 指派 輔導 見學 畢業 畢業典禮 出席率""",
        """educat-, academic, school, school board, university, dean, principal, teacher, lecturer, tutor-, pupil, student, classroom, campus, dormitory, kindergarten, curricul-, syllabus,
        textbook, homework, exam, grade, graded, grade report, thesis, lectur-, semester, scholarship, tuition, enrol-, graduat-, attendance, elective, reading list, remedial, bilingual,
        diligent, pedagog-, vocational, assessed, assigned, mentored, taught, workshop, field trip""",
    ),
    "construction": (
        """營造 工地 工地主任 工程 結構技師 師傅 焊工 泥作 測量員 吊車 起重機 吊車司機 地下室 地基 基樁 鋼樑 鷹架 模板 混凝土 柏油 路面 屋瓦 磚牆 外牆 隔熱 排水 管線 通風管 電梯井
        載重試驗 施工 施工圖 建照 驗收 開挖 澆置 焊接 鋪設 粉刷 拆除 補強 測量 材料場 吊掛""",
        """construct-, contractor, foreman, mason, masonry, surveyor, welder, structural, structural engineer, crane, crane operator, site, building, building permit, permit, blueprint,
        foundation, excavat-, pile, beam, girder, scaffold-, formwork, concrete, asphalt, brickwork, roof, roof tile, facade, insulat-, drainage, duct, ventilation, elevator, elevator shaft,
        plumbing, steel, poured, paved, plaster-, demolish-, erected, reinforc-, levelled, welded, surveyed, load-bearing, load test, seismic, prefabricated, unfinished, waterproof-, yard""",
    ),
}
