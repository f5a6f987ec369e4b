"""Features of crawled pages, and their summary by site."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from firmgraph.functions import dims, urls
from firmgraph.functions.sentences import refusals, surest
from firmgraph.functions.text import EMAIL, company_email, emails, phones
from firmgraph.operators.resolve import Saved, keep_first

BLOCK_TAGS = frozenset("address article aside blockquote br dd div dl dt fieldset footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
SKIPPED = frozenset("script style noscript svg iframe template".split())
PAGE_KINDS = ("title: string", "description: string", "text: string", "links: array<struct<url: string, text: string>>", "has_form: boolean", "has_textarea: boolean", "field_count: int")
#: Pages whose Python objects are there together.
AT_ONCE = 64
PAGE_FIELDS = [f.split(":")[0] for f in PAGE_KINDS]


class _Page(HTMLParser):
    """One pass over a page: title, description, text by block, links, form fields."""

    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.title, self.description, self.texts, self.links = base, None, None, {"main": [], "article": [], "all": []}, []
        self.forms = self.areas = self.fields = 0
        self.skip, self.inside, self.anchor, self.in_title = 0, [], None, False

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in SKIPPED:
            self.skip += 1
        elif tag in ("main", "article"):
            self.inside.append(tag)
        elif tag == "title":
            self.in_title, self.title = True, self.title or ""
        elif tag == "meta" and (a.get("name") or "").lower() == "description":
            self.description = a.get("content")
        elif tag == "a" and a.get("href"):
            self.anchor = [urljoin(self.base, a["href"]), ""]
        elif tag in ("form", "textarea", "select", "input"):
            self.forms += tag == "form"
            self.areas += tag == "textarea"
            self.fields += tag != "form" and (a.get("type") or "text").lower() not in ("hidden", "submit", "button", "image", "reset")
        if tag in BLOCK_TAGS:
            self.add("\n")

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag in self.inside:
            self.inside.remove(tag)
        elif tag == "title":
            self.in_title = False
        elif tag == "a" and self.anchor:
            self.links.append({"url": self.anchor[0], "text": " ".join(self.anchor[1].split())[:120]})
            self.anchor = None
        if tag in BLOCK_TAGS:
            self.add("\n")

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.skip:
            self.add(data)
            if self.anchor:
                self.anchor[1] += data

    def add(self, data):
        for k in {*self.inside, "all"}:
            self.texts[k].append(data)


def read_page(html: str | None, base: str | None, most: int | None) -> dict:
    p = _Page(base or "")
    p.feed(html or "")
    p.close()
    raw = next(("".join(p.texts[k]) for k in ("main", "article", "all") if "".join(p.texts[k]).strip()), "")
    text = re.sub("\n{3,}", "\n\n", re.sub(" *\n *", "\n", re.sub(r"[^\S\n]+", " ", raw.replace("\r", "")))).strip()
    text = f"{p.description}\n{text}" if p.description else text
    return {"title": None if p.title is None else " ".join(p.title.split()), "description": p.description, "text": text[:most], "links": p.links, "has_form": p.forms > 0, "has_textarea": p.areas > 0, "field_count": p.fields}


def page_features(pages: DataFrame, most: int | None = None, parts: tuple[str, ...] = tuple(PAGE_FIELDS)) -> DataFrame:
    """pages(url, html) with page(title, text, links, form fields), or those parts of it that are asked for: only they leave Python.

    most: letters of text that a store keeps, if it has a limit. A batch is read AT_ONCE pages at a time: Python holds objects of so many, the rest stays Arrow's.
    """
    kinds = dict(f.split(": ", 1) for f in PAGE_KINDS)
    schema = ", ".join(f"{p} {kinds[p]}" for p in parts)

    kind = to_arrow_type(StructType.fromDDL(schema))

    @F.arrow_udf(schema)
    def read(html: pa.Array, url: pa.Array) -> pa.Array:
        made = []
        for i in range(0, len(html), AT_ONCE):
            found = [read_page(h, u, most) for h, u in zip(html.slice(i, AT_ONCE).to_pylist(), url.slice(i, AT_ONCE).to_pylist())]
            made.append(pa.array([{p: page[p] for p in parts} for page in found], kind))
        return pa.concat_arrays(made) if made else pa.array([], kind)

    return pages.withColumn("page", read("html", "url"))


#: Patterns of account links by network, and of links that only share.
NETWORKS = {
    "instagram": (r"(?i)^https?://(www\.)?instagram\.com/[^/?#]+", r"instagram\.com/(p|explore|accounts|share)/"),
    "facebook": (r"(?i)^https?://(www\.|m\.)?facebook\.com/[^/?#]+", r"facebook\.com/(sharer|share|dialog|login|plugins)"),
    "x": (r"(?i)^https?://(www\.)?(twitter|x)\.com/[^/?#]+", r"(twitter|x)\.com/(intent|share|home|search|i/)"),
    "youtube": (r"(?i)^https?://(www\.)?youtube\.com/(channel/|c/|user/|@)[^/?#]+", "^$"),
    "linkedin": (r"(?i)^https?://([a-z]{2}\.)?linkedin\.com/(company|in|school)/[^/?#]+", r"linkedin\.com/share"),
    "tiktok": (r"(?i)^https?://(www\.)?tiktok\.com/@[^/?#]+", "^$"),
}
#: Words by which a page shows hiring.
HIRING_TEXT = r"(?i)採用|求人|募集要項|社員募集|リクルート|recruit|career|新卒|中途|entry|エントリー"
HIRING_URL = r"(?i)(recruit|career|saiyo|saiyou|job|kyujin|entry|employment)"


def refusal(text: Column) -> Column:
    """struct(text, pattern, confidence) of the most certain sentence that refuses sales contact; null if there is none."""
    return surest(refusals(text))


def sales_contact_allowed(confidence: Column) -> Column:
    """false where a refusal is certain enough, else unknown: no wording says that contact is welcome."""
    return F.when(confidence >= dims.REFUSED_FROM, "false").otherwise("unknown")


def account_link(links: Column, network: str) -> Column:
    """The first link to an account of a network."""
    pattern, shares = NETWORKS[network]
    return F.regexp_extract(F.get(F.filter(links, lambda x: x["url"].rlike(pattern) & ~x["url"].rlike(shares)), F.lit(0))["url"], pattern, 0)


#: Pages that name a contact but are no form to write to a company.
NOT_FORM_URL = "(?i)(tokushoho|tokutei|ownerinformation|owner_info|privacy|policy|terms|kiyaku|sitemap|law|agreement|recruit|entry|mypage|login|cart|order)"


def contact_form(url: Column, page: Column) -> Column:
    """Whether a page has a form to write to the company: by its URL, or by its words and fields."""
    head = F.substring(page["text"], 1, 2000)
    bad = url.rlike(NOT_FORM_URL) | head.rlike("特定商取引法|特商法に基づく|プライバシーポリシー|個人情報保護方針|利用規約|サイトマップ")
    named = url.rlike("(?i)contact|inquiry|toiawase|form")
    return F.coalesce(page["has_form"] & ~bad & (named | (head.rlike("お問い?合わせ|お問合せ|ご相談") & (page["has_textarea"] | (page["field_count"] >= 3)))), F.lit(False))


def recruiting_signal(pages: DataFrame, site: str) -> DataFrame:
    """site, signal: yes if a page shows hiring, no if a page with text does not, else unknown."""
    shown = F.coalesce(F.col("url").rlike(HIRING_URL), F.lit(False)) | F.coalesce(F.col("page.text").rlike(HIRING_TEXT), F.lit(False)) | F.exists("page.links", lambda x: x["text"].rlike(HIRING_TEXT))
    return pages.groupBy(site).agg(F.when(F.bool_or(shown), "yes").when(F.bool_or(F.length("page.text") > 200), "no").otherwise("unknown").alias("signal"))


def mailto(links: Column) -> Column:
    """The addresses of mail links, lower-cased, without parameters; those that are no addresses are left out."""
    shown = F.transform(F.filter(links, lambda x: F.lower(x["url"]).startswith("mailto:")), lambda x: F.lower(F.trim(F.url_decode(F.regexp_extract(x["url"], "(?i)^mailto:([^?]*)", 1)))))
    return F.filter(shown, lambda e: e.rlike(f"^{EMAIL}$"))


def first_of_site(c: Column, when: Column, order: list[str]) -> Column:
    """The value of the first page, by `order`, where it counts."""
    return F.min_by(c, F.when(when, F.struct(*order)))


def site_summary(pages: DataFrame, site: str, order: list[str] | None = None) -> DataFrame:
    """A row for each site: pages, kinds, the sets of all its pages' addresses and numbers, and the first of its pages that has each thing.

    Pages are in the order of `order` (else of their URL). Sets are united page by page before the shuffle, so a site of many pages
    moves what it shows, not its pages. email is the address that is the company's own.
    """
    order = order or ["url"]
    kind = urls.classify_page(F.col("url"), F.lit(None).cast("string"), F.col("page.title"), urls.root_url(F.col("url")))["page_type"]
    mails = F.array_distinct(F.concat(emails(F.col("page.text")), mailto(F.col("page.links"))))
    rows = pages.select(site, *dict.fromkeys(["url", *order]), "page", kind.alias("kind"), mails.alias("mails"), phones(F.col("page.text")).alias("numbers"), refusal(F.col("page.text")).alias("refusal"), contact_form(F.col("url"), F.col("page")).alias("form"))
    hires = F.col("kind").startswith("recruit") | (F.col("kind") == "job_listing")
    links = {n: F.nullif(account_link(F.col("page.links"), n), F.lit("")) for n in NETWORKS}
    rows = rows.withColumns({f"link_{n}": x for n, x in links.items()}).drop("page")
    first = lambda c, when: first_of_site(c, when, order)
    told = rows.groupBy(site).agg(
        F.count("*").alias("pages"),
        F.array_sort(F.collect_set("kind")).alias("kinds"),
        F.count_if(hires).alias("recruit_pages"),
        first(F.col("url"), F.col("kind") == "contact").alias("contact_page"),
        first(F.col("url"), hires).alias("recruit_page"),
        first(F.col("url"), F.col("form")).alias("contact_form"),
        *[first(F.col(f"link_{n}"), F.col(f"link_{n}").isNotNull()).alias(n) for n in NETWORKS],
        sales_contact_allowed(F.max("refusal.confidence")).alias("sales_contact_allowed"),
        F.min_by("refusal.text", F.when(F.col("refusal").isNotNull(), F.struct((-F.col("refusal.confidence")).alias("less"), *order))).alias("refusal"),
    )
    # united as rows: a set of each site's distinct values, in the order in which they first occur
    def united(column: str, name: str) -> DataFrame:
        each = rows.select(site, F.struct(*order).alias("page_at"), F.posexplode(column).alias("i", "v"))
        firsts = each.groupBy(site, "v").agg(F.min(F.struct("page_at", "i")).alias("at"))
        return firsts.groupBy(site).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias(name))

    none = F.array().cast("array<string>")
    out = told.join(united("mails", "emails"), site, "left").join(united("numbers", "phones"), site, "left")
    out = out.withColumns({"emails": F.coalesce("emails", none), "phones": F.coalesce("phones", none)})
    return out.withColumns({"email": company_email(F.col("emails"), F.col(site)), "phone": F.get("phones", F.lit(0))})


def frontier(links: DataFrame, site: str, most: int) -> DataFrame:
    """The pages that a crawl of `most` pages reads: distinct pages by priority, the shorter URL first of equal ones, with their turn.

    links(site, url, link_text); the home page is the first. Kinds come from URL and link text, as titles are not known yet.
    """
    home = urls.root_url(F.col("url"))
    best = links.withColumn("kind", urls.classify_page(F.col("url"), F.col("link_text"), F.lit(None).cast("string"), home)).filter(urls.is_crawlable(F.col("url")))
    pages = best.groupBy(site, urls.canonical_key(F.col("url")).alias("key")).agg(F.min(F.struct((-F.col("kind.priority")).alias("less"), F.length("url").alias("letters"), "url")).alias("top"))
    turn = F.row_number().over(Window.partitionBy(site).orderBy("top"))
    return pages.withColumn("turn", turn).filter(F.col("turn") <= most).select(site, "turn", "top.url", (-F.col("top.less")).alias("priority"))


#: How many pages of a kind a crawl reads before it takes no more links of that kind.
KIND_CAPS = {"news": 2, "other": 3}
KIND_CAP = 4


def crawl_order(homes: DataFrame, links: DataFrame, titles: DataFrame, most: int) -> DataFrame:
    """site, turn, key, url, kind, priority: the pages that crawls of at most `most` pages read, best first, all sites side by side.

    homes(site, url); links(site, key, url, link_text, at) has the links of each page, by its key, in their order; titles(site, key, title) what pages are called.
    In a round each site reads the best page of its queue (highest priority, then the first queued) and queues the page's links that
    can be crawled and are new, but none of a kind of which enough pages have been read, and none without a kind while the queue is long.
    Visited pages and queues are tables; a round joins the links of one page a site, so there are `most` rounds whatever the sites' sizes.
    """
    saved, c = Saved(homes.sparkSession, "crawl"), F.col
    home = homes.filter(c("url").isNotNull()).groupBy("site").agg(F.min("url").alias("url"))
    start = home.select("site", urls.canonical_key(c("url")).alias("key"), "url", F.lit(None).cast("string").alias("link_text"), F.lit("top").alias("link_kind"), F.lit(1000).alias("priority"), F.lit(0).alias("queued"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("turn"), F.lit(None).cast("string").alias("kind"))
    kind = urls.classify_page(c("url"), c("link_text"), F.lit(None).cast("string"), urls.root_url(c("url")))
    usable = links.filter(urls.is_crawlable(c("url"))).withColumn("k", kind)
    edges = saved.save(usable.select("site", c("key").alias("page"), urls.canonical_key(c("url")).alias("key"), "url", "link_text", c("k.page_type").alias("link_kind"), c("k.priority").alias("priority"), "at"), "edges")
    # each link of a page once, where it stands first
    edges = saved.save(keep_first(edges, ["site", "page", "key"], ["at"]), "edges-once")
    named = titles.groupBy("site", "key").agg(F.min("title").alias("title"))
    state = saved.save(start, "state-0")
    cap = F.lit(KIND_CAP)
    for k, n in KIND_CAPS.items():
        cap = F.when(c("link_kind") == k, n).otherwise(cap)
    for turn in range(1, most + 1):
        queue = state.filter("turn IS NULL")
        pick = keep_first(queue, ["site"], [F.desc("priority"), "queued", "at", "key"]).join(named, ["site", "key"], "left")
        read_kind = F.lit("top") if turn == 1 else urls.classify_page(c("url"), c("link_text"), c("title"), urls.root_url(c("url")))["page_type"]
        pick = saved.save(pick.select("site", "key", read_kind.alias("now")), f"pick-{turn}")
        told = state.join(pick, ["site", "key"], "left").withColumns({"turn": F.when(c("now").isNotNull(), turn).otherwise(c("turn")), "kind": F.coalesce("now", "kind")}).drop("now")
        told = saved.save(told, f"told-{turn}")
        read = told.filter("turn IS NOT NULL").groupBy("site", c("kind").alias("link_kind")).agg(F.count("*").alias("read"))
        waiting = told.groupBy("site").agg(F.count_if(c("turn").isNull()).alias("waiting"))
        new = edges.join(pick.select("site", c("key").alias("page")), ["site", "page"]).join(told.select("site", "key"), ["site", "key"], "left_anti")
        new = new.join(read, ["site", "link_kind"], "left").filter(F.coalesce("read", F.lit(0)) < cap).join(waiting, "site")
        before = F.count("*").over(Window.partitionBy("site").orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
        new = new.withColumn("length", c("waiting") + before).filter((c("link_kind") != "other") | (c("length") <= 2 * most))
        queued = new.select("site", "key", "url", "link_text", "link_kind", "priority", F.lit(turn).alias("queued"), "at", F.lit(None).cast("int").alias("turn"), F.lit(None).cast("string").alias("kind"))
        state = saved.save(told.unionByName(queued), f"state-{turn}")
        for name in (f"state-{turn - 1}", f"pick-{turn}", f"told-{turn}"):
            saved.drop(name)
    return state.filter("turn IS NOT NULL").select("site", "turn", "key", "url", "kind", "priority")


def digital_signals(summary: DataFrame, site: str) -> DataFrame:
    """What a site offers, out of site_summary with the hiring signal of recruiting_signal."""
    there = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    return summary.select(site, (F.col("recruit_pages") > 0).alias("has_recruit_page"), there("contact_form").alias("has_contact_form"), there("email").alias("has_public_email"), sum((there(n).cast("int") for n in NETWORKS), F.lit(0)).alias("networks"), "signal")


def company_patch(companies: DataFrame, sites: DataFrame, id: str) -> DataFrame:
    """New values of companies whose site was crawled.

    What the site shows replaces what is known; a known phone and a manual verification stay, a known address is kept if none
    is found, and a refusal of contact, once known, stays one.
    """
    c = F.col
    rows = companies.join(sites.select(id, *[c(x).alias(f"new_{x}") for x in ("website_url", "email", "phone", "contact_form", "refused")]), id)
    return rows.select(
        id,
        c("new_website_url").alias("website_url"),
        F.when(c("verification_status") == "manual", "manual").otherwise("verified").alias("verification_status"),
        F.coalesce("new_email", "email").alias("email"),
        F.coalesce("phone", "new_phone").alias("phone"),
        c("new_contact_form").alias("contact_form"),
        F.when(F.coalesce("new_refused", F.lit(False)) | (c("sales_contact_allowed") == "false"), "false").otherwise("unknown").alias("sales_contact_allowed"),
        F.lit("crawled").alias("crawl_status"),
    )
