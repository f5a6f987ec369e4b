"""The domain core over hand-written rows: each case applies a library function, and its SQL lists what must come out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firmgraph.functions import names, scoring, text, urls
from firmgraph.operators import crawl, outreach
from firmgraph.sources import registry

QUERIES: dict[str, Callable] = {}
WANTED: dict[str, str] = {}


def query(sql: str, name: str | None = None):
    """Keep a function on hand-written rows with the SQL that lists what must come out."""

    def add(f):
        QUERIES[name or f.__name__], WANTED[name or f.__name__] = f, sql
        return f

    return add


KINDS = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]"}


def literal(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(literal, v)) + "]"
    return str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


def values_sql(columns: dict[str, str], rows: list[tuple]) -> str:
    """SQL that lists rows, with the case's number first."""
    names_ = ["i", *columns]
    cast = lambda v, kind: f"CAST({literal(v)} AS {KINDS[kind]})"
    body = ", ".join("(" + ", ".join([str(i), *[cast(v, k) for v, k in zip(r, columns.values())]]) + ")" for i, r in enumerate(rows))
    return f"SELECT * FROM (VALUES {body}) AS t({', '.join(names_)})"


def cases(name: str, schema: str, rows: list[tuple], columns: dict[str, tuple[str, Callable[[], Column]]], want: list) -> None:
    """Register cases of a function: rows by schema, the columns to compute (type and expression), and what must come out."""
    wanted = [w if isinstance(w, tuple) else (w,) for w in want]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        given = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
        return given.select("i", *[make().alias(c) for c, (_, make) in columns.items()])

    run.__doc__ = f"Cases of {name.replace('_', ' ')}."
    query(values_sql({c: kind for c, (kind, _) in columns.items()}, wanted), f"case_{name}")(run)


def texts(name: str, f: Callable[[Column], Column], pairs: dict, kind: str = "string") -> None:
    cases(name, "s string", [(k,) for k in pairs], {"v": (kind, lambda: f(F.col("s")))}, list(pairs.values()))


texts("half_width", text.half_width, {"ＡＢＣ１２３": "ABC123", "（株）　Ａ": "(株) A", "": "", None: None})
texts("without_legal_form", text.without_legal_form, {"株式会社山田製作所": "山田製作所", "サクラ精密株式会社": "サクラ精密", "（有）田中": "田中", "ABC Co., Ltd.": "ABC", None: None})
texts("company_name", text.company_name, {"株式会社　山田・製作所": "山田製作所", "(株)ＡＢＣ－１": "abc1", "サクラ精密 株式会社": "サクラ精密", None: None})
texts("address", text.address, {"大阪府東大阪市長田中1丁目2番3号": "大阪府東大阪市長田中1-2-3", "〒530-0001 大阪市北区梅田１－２－３": "大阪市北区梅田1-2-3", "京都市上京区二丁目５番地": "京都市上京区2-5", "": None, None: None})
texts("block_numbers", text.block_numbers, {"二丁目": "2-", "十丁目": "10-", "十五丁目": "15-", "二十三丁目": "23-", "一番町": "一番町"})
texts("prefecture", text.prefecture, {"大阪府東大阪市": "大阪府", "〒600 京都府京都市": "京都府", "東成区": None, None: None})
texts("city", text.city, {"大阪府東大阪市長田中1-2-3": "東大阪市", "京都府京都市上京区丸太町": "京都市上京区", "奈良県生駒郡斑鳩町法隆寺": "生駒郡斑鳩町", "大阪府": None, None: None})
texts("address_keys", text.address_keys, {"大阪府東大阪市長田中1-2-3": ["大阪府東大阪市長田中1-", "東大阪市長田中1-2"], "東成区": [], None: []}, "array<string>")
cases("address_appears", "address string, page string", [("大阪府東大阪市長田中1-2-3", "本社 東大阪市長田中1-2-3 電話"), ("大阪府東大阪市長田中1-2-3", "東大阪市長田東1-2-3"), ("大阪府東大阪市長田中1-2-3", "堺市中区"), (None, "x")],
      {"v": ("boolean", lambda: text.appears(text.address_keys(F.col("address")), text.address(F.col("page"))))}, [True, True, False, False])
texts("phone", text.phone, {"０６－１２３４－５６７８": "06-1234-5678", "06(1234)5678": "0612345678", "090 1234 5678": "09012345678", "12345": None, None: None})
texts("corporate_number", text.corporate_number, {"1234567890123": "1234567890123", "１２３４５６７８９０１２３": "1234567890123", "T1234567890123": "1234567890123", "12345": None, None: None})
texts("employee_count", text.employee_count, {"約１，２００名": 1200, "35人": 35, "0": None, "不明": None, None: None}, "long")
texts("company_core", text.company_core, {"株式会社増子製作所": "増子", "大阪製作所": None, "サクラ精密機械工業株式会社": "サクラ", "株式会社": None})
texts("name_tokens", text.name_tokens, {"ABC Works 株式会社": ["abc", "works"], "山田 AB": [], "Any-Ware Inc.": ["any", "ware"]}, "array<string>")
cases("names_related", "a string, b string", [("山田製作所", "山田製作所"), ("山田製作所大阪", "山田製作所"), ("山田製作所", "山田製作處"), ("山田", "田中商店"), ("", "x"), (None, "x")], {"v": ("boolean", lambda: text.names_related(F.col("a"), F.col("b")))}, [True, True, True, False, False, False])
texts("industry", text.industry, {"金属加工業": "manufacturing", "ソフトウェア開発": "it", "飲食店の経営": "food_service", "その他": None})
texts("normal_date", text.normal_date, {"2001年4月1日": "2001-04-01", "1999/12": "1999-12-01", "１９８０": "1980-01-01", "昭和": None, None: None})
texts("redacted", text.redact_secrets, {"failed postgres://u:p@h/db now": "failed *** now", "GET https://a.b/c?x=1 500": "GET *** 500", None: None})
texts("company_name_in_title", names.clean_company_name, {"大阪府豊中市にある金属切削加工の株式会社トーシン": "株式会社トーシン", "株式会社山田製作所の求人情報": "株式会社山田製作所", "「光電気工業」へ": "光電気工業", "株式会社巴商会-": "株式会社巴商会", "大阪の加工業ならイトウ精工株式会社": "イトウ精工株式会社", "たけのこ製作所": "たけのこ製作所"})
texts("name_problem", names.name_problem, {"求人ランキング2026": "list or search", "大阪府電気工事工業組合": "industry body", "株式会社会社情報": "generic words only", "金属加工とは": "article", "あ": "length", "株式会社山田製作所": None, "中田製作所": None, None: "length"})
texts("public_body", registry.is_public_body, {"桜井財産区": True, "大阪地方裁判所": True, "東大阪市役所": True, "独立行政法人中小企業基盤整備機構": True, "堺商工会議所": True, "株式会社山田製作所": False, "国産木材株式会社": True, "": False, None: False}, "boolean")
texts("crawlable", urls.is_crawlable, {"https://a.jp/about": True, "https://a.jp/x.pdf": False, "https://a.jp/wp-admin/": False, "mailto:a@b.jp": False, "https://a.jp/page/2": False}, "boolean")
cases("domain_matches_name", "name string, domain string", [("ABC Works 株式会社", "abcworks.co.jp"), ("山田製作所", "yamada.jp"), ("Any Ware", "any-ware.jp"), (None, "x.jp")], {"v": ("boolean", lambda: urls.domain_matches_name(F.col("name"), F.col("domain")))}, [True, False, True, False])
cases("page_kind", "url string, link string, title string", [("https://a.jp/", None, None), ("https://a.jp/recruit/", "採用情報", None), ("https://a.jp/company/", "会社概要", None), ("https://a.jp/contact", None, "お問い合わせ"), ("https://a.jp/x", None, None), (None, None, None)],
      {"kind": ("string", lambda: urls.classify_page(F.col("url"), F.col("link"), F.col("title"), F.lit("https://a.jp/"))["page_type"]), "priority": ("int", lambda: urls.classify_page(F.col("url"), F.col("link"), F.col("title"), F.lit("https://a.jp/"))["priority"])},
      [("top", 110), ("recruit", 105), ("company", 110), ("contact", 102), ("other", 10), ("other", 0)])
cases("related_site", "a string, b string", [("https://a.jp/x", "http://www.a.jp/"), ("https://shop.a.jp/", "https://a.jp"), ("https://ba.jp", "https://a.jp"), (None, "https://a.jp")], {"v": ("boolean", lambda: urls.related_site(F.col("a"), F.col("b")))}, [True, True, False, False])
texts("phones_of_text", text.phones, {"TEL 06-1234-5678 / FAX 06-1234-5679": ["06-1234-5678", "06-1234-5679"], "06-1234-5678 06-1234-5678": ["06-1234-5678"], "2024-01-01": [], "": []}, "array<string>")
texts("emails_of_text", text.emails, {"info@sakura.co.jp logo@2x.png sample@example.com": ["info@sakura.co.jp"], "recruit [at] sakura.co.jp": ["recruit@sakura.co.jp"], "なし": []}, "array<string>")
cases("company_email", "found array<string>, site string", [(["contact@web-agency.jp", "info@sakura.co.jp"], "sakura.co.jp"), (["info@mail.sakura.co.jp"], "sakura.co.jp"), (["x@ybb.ne.jp"], None), (["a@me.com"], "b.jp"), (["info@unknown.jp"], None), ([], None)],
      {"v": ("string", lambda: text.company_email(F.col("found"), F.col("site")))}, ["info@sakura.co.jp", "info@mail.sakura.co.jp", "x@ybb.ne.jp", "a@me.com", None, None])
cases("refusals", "s string", [("会社概要\n営業メールはお断りしております。\n以上",), ("売り込みは受け付けておりません。",), ("業者の皆様からのご提案はお断りします。",), ("人材紹介のご案内はご遠慮ください。",), ("Unsolicited offers are declined",), ("営業時間は9:00〜18:00です。",), (None,)],
      {"sentence": ("string", lambda: crawl.refusal(F.col("s"))["text"]), "confidence": ("int", lambda: crawl.refusal(F.col("s"))["confidence"]), "allowed": ("string", lambda: crawl.sales_contact_allowed(crawl.refusal(F.col("s"))["confidence"]))},
      [("営業メールはお断りしております。", 95, "false"), ("売り込みは受け付けておりません。", 95, "false"), ("業者の皆様からのご提案はお断りします。", 85, "false"), ("人材紹介のご案内はご遠慮ください。", 88, "false"), ("Unsolicited offers are declined", 80, "unknown"), (None, None, "unknown"), (None, None, "unknown")])
texts("foreign_words_of_draft", lambda s: text.foreign_words(s, outreach.LATIN), {"実際の工夫や judgment を": ["judgment"], "NC旋盤・ISO・e-mail": [], "don't use a@b.co.jp": ["don't", "use"]}, "array<string>")
cases("recruit_reasons", "p boolean, n int, l boolean, e boolean, m boolean, t int, b array<string>, x boolean, r boolean",
      [(True, 3, True, True, False, 1500, ["Indeed"], True, True), (True, 1, False, False, False, 100, [], True, True), (False, 0, False, False, False, 0, ["doda"], False, True), (False, 0, False, False, False, 0, [], False, False), (False, 0, False, False, False, 0, [], False, True)],
      {"target": ("string", lambda: scoring.recruit_target(*[F.col(c) for c in "plemt"][:1], F.col("l"), F.col("e"), F.col("m"), F.col("t"), F.size("b"), F.col("x"))), "reasons": ("array<string>", lambda: scoring.recruit_reasons(*[F.col(c) for c in "pnlemtbxr"]))},
      [("active_recruit", ["採用ページあり（採用関連 3ページ）", "掲載あり: 募集要項 / 社員紹介", "求人媒体: Indeed"]), ("weak_recruit_page", ["採用ページあり（採用関連 1ページ）", "募集要項・社員紹介・メッセージのいずれも見つからない", "採用ページの情報量が少ない（100字）"]),
       ("no_recruit_page", ["公式サイトに採用ページが無い / 求人媒体を利用: doda"]), ("no_signal", ["サイトを十分に読めていないため判断できない"]), ("no_signal", ["採用・求人の記載が見つからない"])])
cases("form_problem", "form string, site string, status string",
      [("https://a.jp/contact/", "https://a.jp/", "verified"), ("https://form.a.jp/contact", "https://a.jp/", "manual"), (None, "https://a.jp/", "verified"), ("https://a.jp/contact", None, "verified"), ("https://a.jp/contact", "https://a.jp", "needs_review"), ("https://www.facebook.com/x", "https://a.jp", "verified"), ("https://a.jp/recruit/entry", "https://a.jp", "verified"), ("https://b.jp/contact", "https://a.jp", "verified")],
      {"v": ("string", lambda: outreach.form_problem(F.col("form"), F.col("site"), F.col("status")))},
      [None, None, "no form", "no confirmed site", "site not verified", "non-official domain", "not a contact form", "form on another site"])
cases("field_purpose", "kind string, name string, label string",
      [("text", "company", "会社名"), ("text", "kana", "フリガナ"), ("text", "mail2", "メールアドレス（確認用）"), ("email", "m", None), ("text", "mail_address", "メールアドレス"), ("tel", "t", ""), ("text", "zip", "郵便番号"), ("text", "address1", "住所"), ("text", "busho", None), ("text", "your_name", "お名前"), ("text", "sei", None), ("textarea", "x", "自由記入"), ("select", "kind", "お問い合わせ種別"), ("select", "x", "都道府県"), ("checkbox", "agree", "個人情報の取扱いに同意"), ("checkbox", "x", "メルマガ"), ("text", "zzz", None)],
      {"v": ("string", lambda: outreach.field_purpose(F.col("kind"), F.col("name"), F.col("label")))},
      ["company", "nameKana", "emailConfirm", "email", "email", "phone", "zip", "address", "department", "name", "name", "body", "inquiryType", "unknown", "consent", "unknown", "unknown"])
cases("inquiry_option", "options array<struct<value: string, text: string>>", [([("", "選択してください"), ("1", "お問い合わせ"), ("2", "取材・メディア")],), ([("1", "製品について"), ("2", "その他")],), ([("", "選択してください")],), ([("1", "製品")],)],
      {"v": ("string", lambda: outreach.inquiry_option(F.col("options"))["value"])}, ["2", "2", None, None])
cases("missing_sender", "company string, name string, email string", [("A", "B", "c@d.jp"), ("", None, "c@d.jp"), (None, "x", "")], {"v": ("array<string>", lambda: outreach.missing_sender({c: F.col(c) for c in ("company", "name", "email")}))}, [([],), (["company", "name"],), (["company", "email"],)])
cases("contactable", "s string", [("true",), ("unknown",), ("false",), (None,)], {"v": ("boolean", lambda: outreach.contactable(F.col("s")))}, [True, True, False, True])
cases("analysis_block", "target string, spent int", [("weak_recruit_page", 10), ("no_signal", 10), ("active_recruit", 100), (None, 0)], {"v": ("string", lambda: outreach.analysis_block(True, True, F.col("target"), F.col("spent"), F.lit(100))), "off": ("string", lambda: outreach.analysis_block(False, True, F.col("target"), F.col("spent"), F.lit(100)))}, [(None, "switched off"), ("no sign of hiring", "switched off"), ("budget spent", "switched off"), (None, "switched off")])
cases("registry_residual", "name string, location string, close_date string, business_items array<string>, business_summary string, employee_number string",
      [("株式会社山田製作所", "大阪府東大阪市1", None, ["金属加工"], None, "35"), ("桜井財産区", "大阪府東大阪市", None, None, None, None), ("株式会社閉鎖", "大阪府東大阪市", "2020-01-01", None, None, None), ("株式会社他市", "大阪府堺市", None, None, None, None), ("株式会社別業", "大阪府東大阪市", None, ["飲食"], None, None), ("株式会社無情報", "大阪府東大阪市", None, [], None, None), ("株式会社小工業", "大阪府東大阪市", None, ["製造"], None, "5"), ("株式会社大工業", "大阪府東大阪市", None, ["製造"], None, "1,500名")],
      {"v": ("string", lambda: registry.residual_reason("東大阪市", "manufacturing", 20, 300))},
      [None, "public body", "closed", "other city", "other industry", None, "too few employees", "too many employees"])


@query(values_sql({"corporate_number": "string", "company_name": "string", "prefecture": "string", "city": "string", "postal_code": "string", "industry": "string", "industry_detail": "string", "employee_count": "long", "capital": "long", "established_date": "string", "website_url": "string"}, [
    ("1234567890123", "株式会社山田製作所", "大阪府", "東大阪市", "577-0013", "manufacturing", "金属加工 / 販売", 120, 10000000, "1985-04-01", "https://yamada.example.jp"),
    (None, "無名", None, None, None, None, None, None, None, None, None),
]))
def case_registry_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry entries as companies."""
    entries = [("1234567890123", " 株式会社山田製作所 ", "大阪府東大阪市長田中1-2", "5770013", ["金属加工", "販売"], None, "１２０人", "10,000,000円", "1985年4月1日", "yamada.example.jp"), ("1", "無名", None, None, None, None, None, "0", None, None)]
    given = spark.createDataFrame([(*e, i) for i, e in enumerate(entries)], "corporate_number string, name string, location string, postal_code string, business_items array<string>, business_summary string, employee_number string, capital_stock string, date_of_establishment string, company_url string, i int")
    order = given.select("i", F.trim("name").alias("company_name"))
    return registry.company_rows(given).drop("address").join(order, "company_name")
