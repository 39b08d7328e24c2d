"""Default rule lists. Every operator takes its lists as parameters; these are presets.

All lists here are fixed values: results depend on them entry by entry and in this order.
"""

# Hosts that a document is excluded for.
EXCLUDED_HOSTS = (
    "shinken-ad.co.jp", "benesse.ne.jp", "keinet.ne.jp", "dnc.ac.jp", "janu.jp", "nhs.uk", "cqc.org.uk",
    "bbc.co.uk", "bbc.com", "blackpoolteachinghospitals.nhs.uk", "uk.a-hospital.com", "pref.saitama.lg.jp",
    "pref.ibaraki.jp", "tochigi-edu.ed.jp", "pref.akita.lg.jp", "pref.iwate.jp", "ibconsortium.mext.go.jp",
    "gender.go.jp", "cao.go.jp", "kouseikyoku.mhlw.go.jp", "bnw-inc.jp", "uploads.guim.co.uk", "jfm.go.jp",
)
# Statistics pages of one host.
STATISTICS_HOST = "mext.go.jp"
STATISTICS_PATTERNS = ("mext_daigakuc", "shinro", "000038206")
# URL patterns of other documents, and those that exclude even with nested units.
URL_PATTERNS = (
    "gokaku", "goukaku", "result", "seiseki", "hekka", "kekka", "goukakusha", "合格者", "合格発表", "成績",
    "youran", "handbook", "syllabus", "jikanwari", "nyugakushiki", "opencampus", "open-campus",
    "chukikeikaku", "johokokai", "kakomon", "kako", "past",
)
STRONG_URL_PATTERNS = ("seiseki", "kekka", "goukakusha", "合格者", "合格発表", "成績")
# Content keywords of other documents, and those that exclude even with nested units.
CONTENT_KEYWORDS = (
    "合格者", "合格発表", "合格点", "合格最低点", "入学式", "シラバス", "時間割", "学生便覧", "学生要覧",
    "中期計画", "情報公開", "年次報告", "紀要", "教員募集", "職員募集", "採用情報",
    "Tax strategy", "tax strategy", "NHS", "hospital", "Blackpool", "blackpool",
)
STRONG_CONTENT_KEYWORDS = ("Tax strategy", "tax strategy", "NHS", "hospital", "Blackpool", "blackpool", "入学式")
# Reasons of the cascade.
REASONS = {
    "host": "除外ドメイン: ", "statistics": "文科省統計ページ: ",
    "url": "非募集要項URLパターン（covered_units無し）: ", "url_strong": "合格発表・成績URL（covered_unitsあり）: ",
    "content": "非募集要項キーワード（covered_units無し）: ", "content_strong": "明らかに無関係なコンテンツ: ",
}
# First-hit URL exclusions of candidates, and positive signals.
CANDIDATE_EXCLUDE = (
    "syllabus", "shillabus", "シラバス", "gakusei_binran", "student_guide", "便覧", "便览", "kinenshi", "kiyou", "紀要",
    "houkoku", "nenjihoukoku", "zaigaku", "sotsugyou", "nyugakushagaiyou", "nyuugakusyagaiyou", "goukakusha", "合格者",
    "kyouin_boshu", "kyoin_boshu", "faculty_recruit", "教員募集", "kenkyusha_boshu", "researcher", "campus_map",
    "campusmap", "timetable", "jikanwari", "kyotsu", "center_test", "daigaku_nyushi_center", "dnc.ac.jp",
    "shiken_kaijo", "試験場", "daigaku_ichiran", "mext_daigakuc", "janu.jp", "keinet.ne.jp", "benesse", "kawaijuku",
    "mynavi", "rikunabi", "passnavi", "keiyu", "kobekyo.com", "nyushi.yahoo", "kakomon", "mondai", "kaito",
    "saitenkijyun", "saiten_kijun", "mensetsu", "hyouka", "hyoka", "mensetu", "syoronbun", "shoronbun",
    "ronbun_hyousi", "nyugakugo", "nyuugakugo", "nyugakusha_gaiyou", "semestar", "rishu", "jugyou", "suisensyo",
    "suisen_syo", "suisenjyo", "sibouriyuusyo", "rireki", "ganshosyo", "wikipedia.org", "wikimedia",
    "uestc.edu.cn", "hokkaido-univcoop.jp",
)
CANDIDATE_POSITIVE = (
    "boshu", "youkou", "yoko", "nyushi", "senbatsu", "shutsugan", "admission", "recruit", "daigakuin",
    "gakubu", "kenkyuka", "masters", "doctor", "ippan", "suisen", "sogouga",
)
# Keywords of the prefilter with fallback.
PREFILTER_KEYWORDS = (
    "募集", "要項", "要项", "boshu", "youkou", "入試", "入学", "nyushi", "nyugaku", "選抜", "senbatsu", "出願",
    "shutsugan", "application", "apply", "大学院", "daigakuin", "graduate", "学部", "gakubu", "undergraduate",
    "修士", "博士", "前期", "後期", "専門職", "master", "doctoral", "phd", "研究科", "kenkyuka", "学府", "gakufu",
    "学院", "一般", "推薦", "外国人", "留学生", "社会人", "admission", "admissions", "enrollment", "entry", "prospectus",
)
# Link texts that exclude, and texts and URLs that keep.
LINK_TEXT_EXCLUDE = (
    "中期目標", "中期計画", "年度計画", "経営協議会", "役職員", "監察", "情報公開", "ディプロマ", "カリキュラムマップ",
    "シラバス", "授業料", "出身所在地別調", "合格者入試成績", "現役・浪人別", "志願者数", "入学者数", "最高点", "平均点",
    "最低点", "入学試験問題", "解答例", "過去問", "大学訪問", "出前講義", "プログラム題目", "印刷用PDF", "別紙", "貸出",
    "Certificate of Eligibility", "クレジット払い",
    "返還請求書", "郵送用紙", "返金申請", "書式", "様式", "申請書", "領収書", "納付書", "振込", "口座",
)
LINK_TEXT_POSITIVE = (
    "募集要項", "選抜要項", "入学者選抜", "出願要領", "出願要項", "学生募集", "入試要項", "Application Guide",
    "Application for", "Guideline", "guideline", "boshu", "youkou", "youryou", "編入学", "社会人", "外国人留学生",
    "研究生", "科目等履修",
)
LINK_URL_POSITIVE = ("youkou", "boshu", "nyushi", "nyugaku", "senbatsu", "shutsugan", "admission", "guideline", "bosyu")
# Document types in order of precedence, and the defaults.
DOC_TYPES = {
    "募集要項": ("boshu", "youkou", "募集要項", "募集要領", "boshuyoko", "nyushi_youkou", "nyugaku_youkou"),
    "選抜要項": ("senbatsu", "選抜要項", "選抜要領", "入学者選抜", "nyuugakusha_senbatsu"),
    "出願要領": ("shutsugan", "出願要領", "出願案内", "出願手続", "application_guide"),
    "入学案内": ("nyugaku_annai", "入学案内", "nyuugaku_annai", "guide", "annai", "campus_guide"),
    "合格発表": ("gokaku", "goukaku", "kekka", "result", "合格発表", "合格者", "合格最低点", "合格点"),
    "学生便覧": ("youran", "handbook", "便覧", "要覧", "student_guide"),
    "成績": ("seiseki", "score", "成績", "試験結果"),
}
DOC_TYPE_WITH_UNITS, DOC_TYPE_OTHER = "募集要項", "その他"
# Tags of the classification step.
EXAM_TAGS = {
    "一般選抜": ("一般選抜", "一般入試", "ippan", "前期日程", "後期日程", "中期日程"),
    "前期日程": ("前期日程", "zenki"),
    "後期日程": ("後期日程", "koki"),
    "学校推薦型選抜": ("学校推薦", "推薦入試", "suisen", "指定校推薦", "公募推薦"),
    "総合型選抜": ("総合型", "AO入試", "AO選抜", "sogo", "自己推薦"),
    "社会人入試": ("社会人", "shakaijin"),
    "外国人留学生": ("外国人", "留学生", "ryugakusei", "外国語"),
    "編入学": ("編入", "hennyu", "転入"),
    "大学院": ("大学院", "修士", "博士", "研究科", "daigakuin"),
    "医歯薬系": ("医学部", "歯学部", "薬学部", "看護"),
}
# Tags of chunks, from nested types and from the text.
CHUNK_TYPE_TAGS = {
    "一般選抜": ("一般", "前期", "後期"), "学校推薦型選抜": ("推薦",), "総合型選抜": ("総合型", "AO"),
    "社会人入試": ("社会人",), "外国人留学生": ("留学生", "外国人"), "編入学": ("編入",),
}
CHUNK_TEXT_TAGS = {
    "一般選抜": ("一般選抜", "一般入試", "前期日程", "後期日程"), "学校推薦型選抜": ("学校推薦", "推薦入試", "指定校推薦"),
    "総合型選抜": ("総合型", "AO入試", "AO選抜"), "社会人入試": ("社会人",), "外国人留学生": ("外国人", "留学生"),
    "編入学": ("編入", "転入"),
}
# Scopes and their labels.
SCOPE_LABELS = {"undergraduate": "学部", "graduate": "大学院・研究科", "combined": "学部・大学院"}
UNDERGRADUATE_PATTERN, GRADUATE_PATTERN = "学部|学科|学群|学類", "研究科|大学院|専攻|修士|博士"
# Headings of sections, for a line without its outer white space.
HEADING_PATTERNS = (
    r"^第\d+章\s*.+", r"^第\d+節\s*.+", r"^[\(（]\d+[\)）]\s*.+", r"^\d+\.\s*.+", r"^\d+\.\d+\s*.+",
    r"^[■□●○◆◇]\s*.+", r"^【.+】", r"^〔.+〕",
)
FIRST_HEADING = "冒頭"
SENTENCE_ENDS = ("。", "！", "？", "\n")
# Names that are no units.
NOISE_NAMES = ("計", "合計", "小計", "総計", "－", "-", "名称", "学部", "学科", "研究科", "専攻", "都道府県", "市区町村")
NOISE_PREFIXES = ("注", "※")
# The prefectures in official order.
PREFECTURES = (
    "北海道", "青森県", "岩手県", "宮城県", "秋田県", "山形県", "福島県", "茨城県", "栃木県", "群馬県", "埼玉県", "千葉県",
    "東京都", "神奈川県", "新潟県", "富山県", "石川県", "福井県", "山梨県", "長野県", "岐阜県", "静岡県", "愛知県", "三重県",
    "滋賀県", "京都府", "大阪府", "兵庫県", "奈良県", "和歌山県", "鳥取県", "島根県", "岡山県", "広島県", "山口県", "徳島県",
    "香川県", "愛媛県", "高知県", "福岡県", "佐賀県", "長崎県", "熊本県", "大分県", "宮崎県", "鹿児島県", "沖縄県",
)
# Profile sites that are no laboratory pages, and the words that speak for one.
PROFILE_DOMAINS = {
    "東京大学": "u-tokyo.ac.jp", "京都大学": "kyoto-u.ac.jp", "大阪大学": "osaka-u.ac.jp", "名古屋大学": "nagoya-u.ac.jp",
    "東北大学": "tohoku.ac.jp", "北海道大学": "hokudai.ac.jp", "九州大学": "kyushu-u.ac.jp",
}
PROFILE_EXCLUDE = (
    r"researchmap\.jp", r"kaken\.nii\.ac\.jp", r"jglobal\.jst\.go\.jp", r"scholar\.google", r"ci\.nii\.ac\.jp",
    "wikipedia", "linkedin", "twitter", "facebook", "/news/", "/topics/", "/events/", "recruit", "nyushi", "admission",
)
SCORE_EXCLUDE = (
    r"researchmap\.jp", r"kaken\.nii\.ac\.jp", r"jglobal\.jst\.go\.jp", r"scholar\.google", r"ci\.nii\.ac\.jp",
    "wikipedia", "linkedin", r"twitter\.com", r"facebook\.com", r"top-researchers\.com", r"lab-search\.com",
    r"dnc\.ac\.jp", "benesse", "mynavi", "rikunabi", r"indeed\.com",
)
SCORE_KEYWORDS = ("lab", "labo", "laboratory", "research", "group", "prof", "faculty")
# Keywords of a search query.
QUERY_EXAM_WORDS = ("一般選抜", "学校推薦型", "総合型", "編入学", "外国人留学生", "社会人")
QUERY_TOPIC_WORDS = ("出願期間", "試験科目", "定員", "募集人員", "合格発表", "出願資格", "配点", "検定料", "入学手続", "前期", "後期", "中期")
QUERY_YEAR_PATTERN = "令和[0-9]+年度|平成[0-9]+年度|[0-9]{4}年度"
# Second-level labels under which a domain has three labels.
SECOND_LEVEL = ("ac", "co", "or", "go", "ne")
# Files that are no pages.
BINARY_SUFFIXES = (".pdf", ".jpg", ".jpeg", ".png", ".gif", ".zip", ".xlsx", ".xls", ".docx", ".doc", ".pptx")
