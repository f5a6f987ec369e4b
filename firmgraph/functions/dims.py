"""Small static dimensions. Results depend on them."""

from __future__ import annotations

#: Prefectures in the order of their JIS codes, 01 to 47.
PREFECTURES = (
    "北海道 青森県 岩手県 宮城県 秋田県 山形県 福島県 茨城県 栃木県 群馬県 埼玉県 千葉県 東京都 神奈川県 新潟県 富山県 石川県 福井県 山梨県 長野県 岐阜県 静岡県 愛知県 三重県 "
    "滋賀県 京都府 大阪府 兵庫県 奈良県 和歌山県 鳥取県 島根県 岡山県 広島県 山口県 徳島県 香川県 愛媛県 高知県 福岡県 佐賀県 長崎県 熊本県 大分県 宮崎県 鹿児島県 沖縄県"
).split()

#: Legal forms that names may carry, as an alternation; order matters.
LEGAL_FORMS = r"株式会社|有限会社|合同会社|合資会社|合名会社|一般社団法人|一般財団法人|公益社団法人|公益財団法人|医療法人社団|医療法人|社会福祉法人|学校法人|特定非営利活動法人|NPO法人|\(株\)|\(有\)|\(同\)|（株）|（有）|（同）|㈱|㈲|Co\.,?\s*Ltd\.?|Inc\.?|Corp\.?|Corporation|Company|Limited|LLC|K\.K\."

#: Employee ranges: key, least, most.
EMPLOYEE_RANGES = (("1-9", 1, 9), ("10-19", 10, 19), ("20-49", 20, 49), ("50-99", 50, 99), ("100-299", 100, 299), ("300-999", 300, 999), ("1000+", 1000, None))

#: Size presets: key, least, most (0 and None: unbounded).
SIZE_PRESETS = {"any": (0, None), "micro": (1, 19), "small": (20, 300), "mid": (100, 999), "large": (1000, None)}

#: Industries and words of a registry entry that name them; the first industry with a word in the text wins.
INDUSTRIES = (
    ("manufacturing", "製造 工業 メーカー 加工"),
    ("construction", "建設 建築 土木 工務店 設備工事 電気工事"),
    ("it", "情報 通信 ソフトウェア システム IT インターネット"),
    ("wholesale_retail", "卸売 小売 販売 商事 商店"),
    ("logistics", "運輸 運送 物流 倉庫 配送"),
    ("real_estate", "不動産 賃貸 住宅"),
    ("food_service", "飲食 レストラン ホテル 宿泊 フード"),
    ("medical_welfare", "医療 福祉 介護 クリニック 病院 薬局"),
    ("education", "教育 学習 スクール 塾"),
    ("professional", "コンサル 会計 税理士 法律 設計 デザイン 広告"),
    ("services", "サービス 人材 清掃 警備 整備"),
    ("finance", "金融 保険 信用"),
    ("agriculture", "農業 農園 林業 漁業 水産"),
    ("energy", "電力 ガス エネルギー 水道"),
    ("lifestyle", "美容 理容 エステ フィットネス 娯楽 旅行"),
)

#: How far a source is trusted for a value.
SOURCE_PRIORITY = {"gbiz": 100, "edinet": 90, "official_web": 80, "google_places": 60, "web_search": 30}

#: Endings of names that say the industry; names that are only a place.
INDUSTRY_ENDINGS = "製作所|製造所|工業所|工作所|鉄工所|鋳造所|製鋼所|加工所|グループ|ホールディングス|ホールディング|自動車|工業|産業|製造|製作|精機|精密|機械|機工|鉄工|鋳造|電機|電気|化学|樹脂|金属|商会|商事|運輸|建設|設備|工務店|製菓|食品"
GENERIC_CORES = "大阪 京都 神戸 兵庫 東京 名古屋 滋賀 奈良 和歌山 岐阜 愛知 九州 関西 関東 日本 日本橋 中央 共和 共栄".split()

#: Hosts that are no company's own site: social networks, job boards, directories, portals.
NON_OFFICIAL_DOMAINS = (
    "facebook.com twitter.com x.com instagram.com youtube.com linkedin.com tiktok.com wantedly.com indeed.com en-japan.com mynavi.jp rikunabi.com doda.jp type.jp green-japan.com "
    "hatarako.net baitoru.com townwork.net engage.jp houjin.jp baseconnect.in kaisha.co salesnow.jp alarmbox.jp musubu.in uzabase.com bizdb.jp jpnumber.com mapion.co.jp navitime.co.jp "
    "google.com goo.gl yahoo.co.jp tabelog.com hotpepper.jp ekiten.jp itp.ne.jp wikipedia.org amazon.co.jp rakuten.co.jp ameblo.jp note.com hatenablog.com wixsite.com jimdofree.com prtimes.jp "
    "nikkei.com openwork.jp vorkers.com en-hyouban.com jobtalk.jp kaisha-hyoban.com metoree.com aperza.com bconnect.jp mitsu-ri.net proteg.jp hakenlist.com monodzukuri.com kinzoku-kakou.net "
    "imitsu.jp ipros.jp ipros.com nc-net.or.jp tsukuruo.jp misumi-ec.com monotaro.com zenrin.co.jp job-medley.com kyujin-box.com jobcan.ne.jp houjinbase.com goo.to fumadata.com j-lic.com "
    "mono-web.jp yao-mono.jp houjin-navi.com corporate-number.com nta.go.jp gbiz.go.jp baseconnect.jp sansan.com eight.evercam.jp meti-mono.jp goo.ne.jp buzip.net e-shops.jp bigcompany.jp "
    "jpubb.com i-o-m.jp bsj.jp mapfan.com kaisharesearch.com g-search.or.jp always-basics.com companyinformation.jp compalyze.co.jp helloboss.com ullet.com tdb.co.jp tsr-net.co.jp navikyo.com "
    "tsukulink.net sia-japan.com kptc.jp act-kyoto.jp kyoto-hitoiro.com its-mo.com navitime.com tel-search.jp"
).split()
GOVERNMENT_DOMAIN = r"\.lg\.jp$|\.go\.jp$|(^|\.)city\.[^.]+\.jp$|(^|\.)pref\.[^.]+\.jp$"
ORGANIZATION_DOMAIN = r"\.(or|gr|ac|ed)\.jp$"
JOB_BOARD_DOMAIN = r"(?i)(^|\.)(indeed\.com|rikunabi\.com|mynavi\.jp|doda\.jp|en-japan\.com|en-gage\.net|wantedly\.com|baitoru\.com|townwork\.net|hellowork\.mhlw\.go\.jp|hellowork\.go\.jp|job-medley\.com|green-japan\.com|type\.jp|workport\.co\.jp)$"

#: Hosts of free mail that small companies use.
FREE_MAIL_DOMAINS = (
    "gmail.com", "yahoo.co.jp", "ybb.ne.jp", "outlook.com", "outlook.jp", "hotmail.com", "hotmail.co.jp", "icloud.com", "me.com", "nifty.com", "nifty.ne.jp",
    "so-net.ne.jp", "ocn.ne.jp", "biglobe.ne.jp", "plala.or.jp", "dion.ne.jp", "auone.jp", "ezweb.ne.jp", "docomo.ne.jp", "softbank.ne.jp", "zoho.com",
)

#: How sites refuse sales contact: wording, label, how certain it is.
REFUSALS = (
    (r"営業(目的|関係|活動)?(の|での|による)?(メール|ご?連絡|お?問い?合わせ|お?電話|ご?案内|勧誘|売り込み)[^。\n]{0,20}?(お断り|ご遠慮|禁止|固くお断り|お受け(して)?おりません|受け付けておりません|ご遠慮ください|お控えください)", "営業目的の連絡お断り", 95),
    (r"(セールス|売り込み|勧誘)(目的)?(の|での)?(メール|ご?連絡|お?問い?合わせ|お?電話|ご?案内)?[^。\n]{0,20}?(お断り|ご遠慮|禁止|お受け(して)?おりません|受け付けておりません|お控えください)", "セールス目的の連絡お断り", 95),
    (r"営業(メール|電話|の?お電話|目的のお問い?合わせ|目的でのフォーム(の)?(ご)?利用|目的での(ご)?利用)[^。\n]{0,10}(は)?(固く)?(お断り|禁止|ご遠慮)", "営業連絡禁止", 95),
    (r"(お問い?合わせ|本)フォーム[^。\n]{0,30}?(営業|セールス|売り込み|勧誘)[^。\n]{0,30}?(ご利用|使用|利用)[^。\n]{0,10}?(お断り|ご遠慮|禁止|できません|お控え)", "フォームの営業利用禁止", 92),
    (r"(営業|セールス|売り込み|勧誘)[^。\n]{0,15}(お断り|ご遠慮|禁止)", "営業・勧誘お断り（短文）", 80),
    (r"(業者|取引先|新規取引)[^。\n]{0,10}(の|からの|様からの)?(ご?提案|営業|売り込み)[^。\n]{0,20}(お断り|ご遠慮|受け付けておりません)", "業者からの提案お断り", 85),
    (r"(広告|求人媒体|人材紹介|人材派遣|SEO|ホームページ制作)[^。\n]{0,10}(の)?(営業|ご?案内|ご?提案|売り込み)[^。\n]{0,15}(お断り|ご遠慮|禁止)", "特定業種の営業お断り", 88),
    (r"(?i)(solicitation|unsolicited)[^.\n]{0,40}(not accepted|prohibited|declined|refuse)", "英語表記の営業お断り", 80),
    (r"(営業|セールス)[^。\n]{0,10}(ご遠慮いただいております|ご遠慮願います|ご遠慮下さい)", "営業ご遠慮", 90),
)
REFUSED_FROM = 85

#: Page kinds: name, pattern of the URL, pattern of link text and title, priority. Earlier rules win ties.
PAGE_RULES = (
    ("recruit_new_graduate", "newgrad|new-grad|shinsotsu|fresh|graduate", "新卒|学生|20\\d\\d年?卒", 100),
    ("recruit_mid_career", "mid-?career|chuto|tenshoku|experienced|keikensha", "中途|キャリア採用|経験者", 100),
    ("job_listing", "job|jobs|position|opening|boshu|kyujin|entry", "求人|募集要項|募集職種|募集中|エントリー", 85),
    ("recruit", "recruit|careers?|saiyo|saiyou|employment|join", "採用|リクルート|求人|一緒に働く", 95),
    ("company", "company|about|corporate|profile|outline|gaiyo|gaiyou|kaisha|overview", "会社概要|企業情報|会社案内|企業概要|会社情報|私たちについて", 100),
    ("business", "business|service|services|products?|jigyo|jigyou|solution|works", "事業内容|事業紹介|サービス|製品|商品|業務内容|取扱", 80),
    ("message", "message|greeting|ceo|president|top-message|aisatsu", "代表挨拶|代表メッセージ|トップメッセージ|社長|ご挨拶", 60),
    ("employee", "staff|member|people|interview|voice|crosstalk", "社員紹介|スタッフ紹介|社員インタビュー|先輩社員|社員の声|メンバー", 65),
    ("news", "news|topics|info|information|release|blog|oshirase", "ニュース|お知らせ|新着情報|トピックス|プレスリリース|ブログ", 50),
    ("contact", "contact|inquiry|toiawase|otoiawase|form", "お問い?合わせ|お問合せ|ご相談|資料請求|コンタクト", 92),
    ("privacy", "privacy|policy|terms|kiyaku|sitemap|legal", "プライバシー|個人情報|利用規約|サイトポリシー|サイトマップ", 30),
)

#: Identity evidence: signal, points; thresholds of the total.
VERIFICATION_POINTS = (("corporate_number", 40), ("official_source", 10), ("website_name", 20), ("address", 15), ("phone", 10), ("domain", 10), ("multi_source", 5))
VERIFIED_FROM, REVIEW_FROM, OFFICIAL_SITE_FROM = 80, 60, 60

#: US dollars for a million tokens: input, output. Cache writes cost 1.25 times, cache reads 0.1 times the input rate.
TOKEN_RATES = {"A": (5.0, 25.0), "N": (3.0, 15.0)}
