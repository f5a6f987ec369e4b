"""Values that results depend on: refusals, mail hosts, foreign words, names, reasons. Hand-written cases."""

import pytest
from pyspark.sql import functions as F

from firmgraph.functions import names, scoring, text
from firmgraph.operators import crawl, outreach


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, s {kind}")
    return [r["v"] for r in rows.select("i", expression(F.col("s")).alias("v")).orderBy("i").collect()]


REFUSING = [
    "営業メールはお断りしております。", "営業目的のお問い合わせはご遠慮ください。", "セールス目的のご連絡は固くお断りいたします。", "営業電話は禁止です。", "売り込みのご連絡はお受けしておりません。",
    "営業目的でのフォーム利用は禁止しています。", "※当フォームを営業・勧誘目的でご利用いただくことはご遠慮ください。", "広告や求人媒体の営業のご案内はお断りしています。",
    "売り込みは受け付けておりません。", "業者の皆様からのご提案はお断りします。", "人材紹介のご案内はご遠慮ください。", "セールスは一切お断り。",
]


def test_refusals(spark):
    for sentence, hits in zip(REFUSING, column(spark, [f"会社概要\n{x}\nありがとうございます。" for x in REFUSING], crawl.refusals)):
        assert hits and hits[0]["confidence"] >= 85 or hits[0]["confidence"] == 80
        assert hits[0]["text"] == sentence
        assert [h["confidence"] for h in hits] == sorted((h["confidence"] for h in hits), reverse=True)
    none = ["営業時間は9:00〜18:00です。営業所は大阪にあります。", "営業部の採用を強化しています。", "", None]
    assert column(spark, none, crawl.refusals) == [[]] * 4 and column(spark, none, crawl.refusal) == [None] * 4
    long = "営業メールはお断り" + "あ" * 100
    assert len(column(spark, [long], crawl.refusal)[0]["text"]) == len("営業メールはお断り") + 60
    many = "".join(f"{i}番の営業電話は禁止です。" for i in range(9))
    assert len(column(spark, [many], crawl.refusals)[0]) == 5
    allowed = lambda s: crawl.sales_contact_allowed(crawl.refusal(s)["confidence"])
    assert column(spark, ["営業目的のお問い合わせはお断りします。", "Solicitation is not accepted here.", None], allowed) == ["false", "unknown", "unknown"]


@pytest.mark.parametrize("found,site,mail", [
    (["contact@web-agency.jp", "info@sakura.co.jp"], "sakura.co.jp", "info@sakura.co.jp"), (["info@mail.sakura.co.jp"], "sakura.co.jp", "info@mail.sakura.co.jp"), (["a@gmail.com"], "sakura.co.jp", "a@gmail.com"),
    (["info@yahoo.co.jp"], "sakura.co.jp", "info@yahoo.co.jp"), (["x@ybb.ne.jp"], None, "x@ybb.ne.jp"), (["x@ocn.ne.jp"], "a.jp", "x@ocn.ne.jp"), (["x@me.com"], None, "x@me.com"), (["x@docomo.ne.jp"], None, "x@docomo.ne.jp"),
    (["contact@web-seisaku-agency.jp"], "sakura.co.jp", None), (["support@cms-vendor.com", "sales@printing.co.jp"], "sakura.co.jp", None), ([], "sakura.co.jp", None), ([], None, None), (["info@unknown-vendor.jp"], None, None),
])
def test_company_email(spark, found, site, mail):
    assert spark.createDataFrame([(found, site)], "f array<string>, s string").select(text.company_email(F.col("f"), F.col("s")).alias("v")).first()["v"] == mail


def test_foreign_words(spark):
    found = lambda s: text.foreign_words(s, outreach.LATIN)
    cases = {"実際の工夫や judgment を記事として": ["judgment"], "NC旋盤・ISO・STEPファイル": [], "e-mail と web と DX": [], "don't use state-of-the-art": ["don't", "use", "state-of-the-art"], "a@b.co.jp https://x.jp/some/page です": [], "A-b c": ["A-b"]}
    assert column(spark, list(cases), found) == list(cases.values())


def test_names(spark):
    titles = {
        "大阪府豊中市にある金属切削加工の株式会社トーシン": "株式会社トーシン", "金属加工・切削加工|大阪|大一精工株式会社": "大一精工株式会社", "株式会社キムラテック": "株式会社キムラテック", "Naniwa Kogyo 34株式会社": "Naniwa Kogyo 34株式会社",
        "大阪 精密機器株式会社": "大阪 精密機器株式会社", "大阪の加工業ならイトウ精工株式会社": "イトウ精工株式会社", "アルミ加工・精密加工・微細加工の中田製作所": "中田製作所", "金属から樹脂まで高精度精密機械加工技術の河内金属製作所": "河内金属製作所",
        "たけのこ製作所": "たけのこ製作所", "株式会社きのこ": "株式会社きのこ", "「光電気工業」へ": "光電気工業", "栗本加工へ": "栗本加工", "株式会社巴商会-": "株式会社巴商会", "大阪の金属加工なら山田製作所株式会社です": "山田製作所株式会社",
    }
    assert column(spark, list(titles), names.clean_company_name) == list(titles.values())
    reasons = {
        None: "length", "あ": "length", "ステンレスなどの金属加工をお探しなら株式会社": "phrase before a legal form", "大阪市役所": "public office", "大阪府電気工事工業組合": "industry body", "電気機器": "generic words only", "熱処理技術": "generic words only",
        "株式会社会社情報": "generic words only", "実像~ 大阪ブランド 家電パネル": "heading of several words", "金属加工 大阪": "place in a title", "金属加工とは": "article", "工場 [3社]": "number of companies", "おすすめ10選": "list or search",
        "大阪府の金属加工業者": "kind of company", "株式会社山田製作所": None, "Naniwa Precision Works": None, "中田製作所": None, "京都 前川工業化学株式会社": None,
    }
    assert column(spark, list(reasons), names.name_problem) == list(reasons.values())


def test_recruit_reasons(spark):
    schema = "p boolean, n int, l boolean, e boolean, m boolean, t int, b array<string>, x boolean, r boolean"
    cases = [
        ((True, 3, True, True, False, 1500, ["Indeed"], True, True), ["採用ページあり（採用関連 3ページ）", "掲載あり: 募集要項 / 社員紹介", "求人媒体: Indeed"]),
        ((True, 1, False, False, False, 100, [], True, True), ["採用ページあり（採用関連 1ページ）", "募集要項・社員紹介・メッセージのいずれも見つからない", "採用ページの情報量が少ない（100字）"]),
        ((False, 0, False, False, False, 0, ["Indeed", "doda"], False, True), ["公式サイトに採用ページが無い / 求人媒体を利用: Indeed / doda"]),
        ((False, 0, False, False, False, 0, [], True, True), ["公式サイトに採用ページが無いが、本文に採用・求人の記載がある"]),
        ((False, 0, False, False, False, 0, [], False, False), ["サイトを十分に読めていないため判断できない"]),
        ((False, 0, False, False, False, 0, [], False, True), ["採用・求人の記載が見つからない"]),
    ]
    rows = spark.createDataFrame([c for c, _ in cases], schema).coalesce(1)
    got = [r["v"] for r in rows.select(scoring.recruit_reasons(*[F.col(c) for c in "pnlemtbxr"]).alias("v")).collect()]
    assert got == [w for _, w in cases]
