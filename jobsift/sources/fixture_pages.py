"""Landed payloads derived from the postings view, in each board's format.

Each board's rows are grouped into pages / payloads of a bounded number of
items (``collect_list`` over at most ``PAGE_ITEMS`` rows, ordered by seq),
so the adapters are exercised on realistic shapes whose size grows with the
documents table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import BOARD_NAMES

PAGE_ITEMS = 25
RUN_TS = "2024-01-31 00:00:00"
TEAM_BLURB = "Join our team building the future of work. Competitive equity, benefits and learning budget."


def esc(c) -> Column:
    """HTML-escape text (&, <, >, double quote)."""
    c = F.col(c) if isinstance(c, str) else c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def hours_old(run_ts: str = RUN_TS) -> Column:
    return F.expr(f"timestampdiff(HOUR, posted_at, TIMESTAMP '{run_ts}')").cast("string")


def iso_z(c: str = "posted_at") -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _s(c) -> Column:
    return F.col(c).cast("string")


def card_html(board: str) -> Column:
    seq, title, company = _s("seq"), esc("title"), esc("company")
    when_known = F.col("posted_at").isNotNull()
    if board == "linkedin":
        t = F.when(when_known, F.concat(F.lit('<time class="job-search-card__listdate" datetime="'), iso_z(),
                                        F.lit('">'), hours_old(), F.lit(" hours ago</time>"))).otherwise(F.lit(""))
        return F.concat(F.lit('<li><div class="base-card"><a class="base-card__full-link" '
                              'href="https://www.linkedin.com/jobs/view/'), seq,
                        F.lit('/?trk=public_jobs"><span class="sr-only">'), title,
                        F.lit('</span></a><div class="base-search-card__info"><h3 class="base-search-card__title">'),
                        title, F.lit('</h3><h4 class="base-search-card__subtitle">'
                                     '<a href="https://www.linkedin.com/company/acme">'), company,
                        F.lit("</a></h4>"), t, F.lit("</div></div></li>"))
    if board == "wellfound":
        t = F.when(when_known, F.concat(F.lit('<span class="styles_posted">'), hours_old(),
                                        F.lit(" hours ago</span>"))).otherwise(F.lit(""))
        return F.concat(F.lit('<div data-test="job-search-result"><div class="styles_component"><h2 class="styles_title">'
                              '<a href="/jobs/'), seq, F.lit('-opening">'), title,
                        F.lit('</a></h2><a class="styles_companyLink" href="/company/acme">'), company,
                        F.lit("</a>"), t, F.lit("</div></div>"))
    if board == "builtin":
        t = F.when(when_known, F.concat(F.lit('<span class="fs-xs fw-bold bg-gray-01 font-Montserrat text-gray-03 '
                                              'rounded-1 py-xs px-sm">'), hours_old(), F.lit(" Hours Ago</span>"))) \
            .otherwise(F.lit(""))
        return F.concat(F.lit('<div class="job-bounded-responsive"><div class="company-row">'
                              '<a data-id="company-title" href="/company/acme"><span>'), company,
                        F.lit('</span></a></div><h2><a data-id="job-card-title" href="'),
                        F.when(F.col("seq") % 2 == 0, F.lit("/jobs/")).otherwise(F.lit("/job/opening/")), seq,
                        F.lit('">'), title, F.lit("</a></h2>"), t,
                        F.lit('<div class="job-summary">'), esc("description"),
                        F.lit("</div></div>"))
    if board == "roberthalf":
        worksite = F.element_at(F.array(F.lit("Remote"), F.lit("Hybrid"), F.lit("Onsite")),
                                (F.col("seq") % 3 + 1).cast("int"))
        emp = F.element_at(F.array(F.lit("Contract to Hire"), F.lit("Permanent / Full Time"), F.lit("Temporary"),
                                   F.lit("Part Time")), (F.col("seq") % 4 + 1).cast("int"))
        date = F.when(when_known, iso_z()).otherwise(F.lit(""))
        smin = (F.col("base_score") * 1000).cast("string")
        smax = F.when(F.col("seq") % 2 == 0, (F.col("base_score") * 1200).cast("string")).otherwise(F.lit(""))
        return F.concat(F.lit('<rhcl-job-card job-id="JOB-'), seq, F.lit('"><a slot="headline" '
                              'href="https://www.roberthalf.com/us/en/job/'), seq, F.lit('">'), title,
                        F.lit('</a><ul slot="job-info"><li data-subslot="location">'), esc("location"),
                        F.lit('</li><li data-subslot="worksite">'), worksite,
                        F.lit('</li><li data-subslot="type">'), emp,
                        F.lit('</li><li data-subslot="copy">'), esc(esc("description")),
                        F.lit('</li><li data-subslot="date">'), date,
                        F.lit('</li><li data-subslot="salary-min">'), smin,
                        F.lit('</li><li data-subslot="salary-max">'), smax,
                        F.lit('</li><li data-subslot="salary-period">year</li></ul></rhcl-job-card>'))
    if board == "workatastartup":
        label = F.element_at(F.array(F.lit("Remote"), F.lit("Hybrid"), F.lit("On-site")),
                             (F.col("seq") % 3 + 1).cast("int"))
        t = F.when(when_known, F.concat(F.lit('<time datetime="'), iso_z(), F.lit('"></time>'))).otherwise(F.lit(""))
        # every third job is linked a second time on its page: one id, one card
        again = F.when(F.col("seq") % 3 == 0, F.concat(F.lit('<a href="/jobs/'), seq, F.lit('">Apply</a>'))) \
            .otherwise(F.lit(""))
        return F.concat(F.lit('<div class="job-listing"><div class="company-name"><a href="/company/acme-'), seq,
                        F.lit('">'), company, F.lit('</a></div><div class="job-name"><a href="/jobs/'), seq,
                        F.lit('">'), title, F.lit(" at "), company,
                        F.lit('</a></div><div class="job-details"><span class="job-location">'), esc("location"),
                        F.lit("</span><span>"), label, F.lit("</span>"), t,
                        F.lit(f"</div><p>{TEAM_BLURB}</p>"), again, F.lit("</div>"))
    raise ValueError(board)


#: Markup after the cards of a page: elements that look like cards but lack
#: what a card needs, and (startup board) a second link to the first job.
NO_CARDS = {
    "linkedin": '<li><h3 class="title">No link</h3></li>',
    "wellfound": '<div data-test="job-alert"><h2>No link</h2></div><div data-test="job-x"><p>No title, no link</p></div>',
    "builtin": '<div data-id="job-card-title">No address</div>',
    "roberthalf": '<rhcl-job-card job-id="X"><a slot="headline" href="/x">No info</a></rhcl-job-card>'
                  '<rhcl-job-card job-id="Y"><a slot="headline">No address</a><ul slot="job-info"></ul></rhcl-job-card>',
    "workatastartup": '<a href="/jobs/new">Not a number</a>',
}


def _grouped(df: DataFrame, body_item: Column, board: str, wrap: tuple[str, str]) -> DataFrame:
    b_idx = BOARD_NAMES.index(board)
    items = (df.filter(F.col("source") == board)
               .select((F.col("seq") / (PAGE_ITEMS * 9)).cast("long").alias("_pg"), "seq", body_item.alias("_item")))
    pages = items.groupBy("_pg").agg(F.array_sort(F.collect_list(F.struct("seq", "_item"))).alias("_items"))
    return pages.select(
        (F.col("_pg") * 16 + b_idx).alias("page_id"), F.lit(board).alias("source"), F.lit(1).alias("role_id"),
        F.lit(0).alias("search_cell"),
        F.concat(F.lit(wrap[0]), F.array_join(F.transform("_items", lambda x: x["_item"]), ""), F.lit(wrap[1]))
        .alias("body"))


CARD_BOARDS = ["linkedin", "wellfound", "builtin", "roberthalf", "workatastartup"]


def card_pages(postings: DataFrame) -> DataFrame:
    """One HTML page per board and block of rows, in each board's card markup."""
    out = None
    for b in CARD_BOARDS:
        tag = "ul" if b == "linkedin" else "main"
        wrap = (f"<html><body><{tag}>", f"{NO_CARDS[b]}</{tag}></body></html>")
        page = _grouped(postings, card_html(b), b, wrap)
        out = page if out is None else out.unionByName(page)
    return out


#: Of the structured-data board's pages, every third shows cards beside its
#: script; on every fourth (from the second) each seventh item is a bare string,
#: which ends the reading of its script.
CARD_PAGE_EVERY, BAD_PAGE_EVERY, BAD_ITEM_EVERY = 3, 4, 7


def page_number(seq: str = "seq") -> Column:
    return (F.col(seq) / (PAGE_ITEMS * 9)).cast("long")


def jsonld_item() -> Column:
    """An ItemList element wrapping a JobPosting, or a bare string."""
    posting = F.struct(
        F.lit("JobPosting").alias("@type"), F.col("title").alias("title"),
        F.struct(F.lit("Organization").alias("@type"), F.col("company").alias("name")).alias("hiringOrganization"),
        F.struct(F.lit("Place").alias("@type"), F.struct(F.col("location").alias("addressLocality"))
                 .alias("address")).alias("jobLocation"),
        F.concat(F.lit("https://wellfound.com/jobs/"), _s("seq")).alias("url"),
        F.coalesce(iso_z(), F.lit("")).alias("datePosted"),
        F.col("description"))
    item = F.to_json(F.struct(F.lit("ListItem").alias("@type"), F.col("seq").alias("position"), posting.alias("item")))
    bad = (page_number() % BAD_PAGE_EVERY == 1) & (F.col("seq") % BAD_ITEM_EVERY == 0)
    return F.when(bad, F.lit('"withdrawn"')).otherwise(item)


def jsonld_pages(postings: DataFrame) -> DataFrame:
    """Pages of the startup-list board carrying an ld+json ItemList; some with
    cards of the same postings, which then count instead."""
    head = ('<html><head><script type="application/ld+json">'
            '{"@context":"https://schema.org","@type":"ItemList","itemListElement":[')
    b_idx = BOARD_NAMES.index("wellfound")
    items = (postings.filter(F.col("source") == "wellfound")
                     .select(page_number().alias("_pg"), "seq", F.replace(jsonld_item(), F.lit("</"), F.lit("<\\/")).alias("_item"),
                             card_html("wellfound").alias("_card")))
    pages = items.groupBy("_pg").agg(F.array_sort(F.collect_list(F.struct("seq", "_item", "_card"))).alias("_items"))
    cards = F.when(F.col("_pg") % CARD_PAGE_EVERY == 0, F.array_join(F.transform("_items", lambda x: x["_card"]), "")).otherwise(F.lit(""))
    return pages.select(
        (F.col("_pg") * 16 + b_idx).alias("page_id"), F.lit("wellfound").alias("source"), F.lit(1).alias("role_id"),
        F.lit(0).alias("search_cell"),
        F.concat(F.lit(head), F.array_join(F.transform("_items", lambda x: x["_item"]), ","),
                 F.lit(']}</script></head><body><div id="root">'), cards, F.lit("</div></body></html>")).alias("body"))


#: Every fifth payload, feed and structured-data page (from the fourth) is cut
#: off in the middle of its body, and every fifth from the third has none.
CUT_EVERY = 5


def damaged(pages: DataFrame, number: Column) -> DataFrame:
    return pages.withColumn("body", F.when(number % CUT_EVERY == 3, F.substring("body", F.lit(1), F.length("body") - 40))
                            .when(number % CUT_EVERY != 2, F.col("body")))


def json_payloads(postings: DataFrame) -> DataFrame:
    """API payloads for the three JSON boards (``token`` names the company board)."""
    def grouped(board: str, key: str, item: Column, token: Column) -> DataFrame:
        items = (postings.filter(F.col("source") == board)
                         .select((F.col("seq") / (PAGE_ITEMS * 9)).cast("long").alias("_pg"), "seq", item.alias("_j")))
        g = items.groupBy("_pg").agg(F.array_sort(F.collect_list(F.struct("seq", "_j"))).alias("_items"))
        return g.select(F.lit(1).alias("role_id"), F.lit(board).alias("source"), F.lit(0).alias("search_cell"),
                        F.col("_pg").alias("payload_id"), token.alias("token"),
                        F.to_json(F.struct(F.transform("_items", lambda x: x["_j"]).alias(key))).alias("body"))

    remote = F.struct(F.col("seq").alias("id"), "title", F.col("company").alias("company_name"), "url",
                      "description", F.coalesce(iso_z(), F.lit("")).alias("publication_date"))
    eu = F.struct(F.concat(F.lit("job-"), _s("seq")).alias("slug"), "title", F.col("company").alias("company_name"),
                  "location", "url", "description", (F.col("seq") % 2 == 0).alias("remote"),
                  F.coalesce(F.unix_seconds("posted_at"), F.lit(0)).alias("created_at"))
    company = F.struct(F.col("seq").alias("id"), "title", F.col("url").alias("absolute_url"),
                       esc(F.concat(F.lit("<div><p>"), esc("description"), F.lit("</p></div>"))).alias("content"),
                       F.when(F.col("seq") % 3 == 0, F.lit(None)).otherwise(iso_z()).alias("first_published"),
                       F.coalesce(iso_z(), F.lit("")).alias("updated_at"),
                       F.when(F.col("seq") % 4 == 0, F.lit("")).otherwise(F.col("company")).alias("company_name"),
                       F.struct(F.col("location").alias("name")).alias("location"))
    token = F.when(F.col("_pg") % 2 == 0, F.lit("stripe")).otherwise(F.lit("airbnb"))
    return (grouped("remotive", "jobs", remote, F.lit(None).cast("string"))
            .unionByName(grouped("arbeitnow", "data", eu, F.lit(None).cast("string")))
            .unionByName(grouped("greenhouse", "jobs", company, token)))


def rss_item() -> Column:
    """A feed entry: 'Company: Title' title, HTML summary."""
    def x(c) -> Column:
        return esc(c)
    pub = F.when(F.col("posted_at").isNotNull(),
                 F.concat(F.lit("<pubDate>"), F.date_format("posted_at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000"),
                          F.lit("</pubDate>"))).otherwise(F.lit(""))
    author = F.when(F.col("seq") % 3 == 0, F.lit("")).otherwise(
        F.concat(F.lit("<author>"), x("company"), F.lit("</author>")))
    region = F.when(F.col("seq") % 2 == 0, F.lit("")).otherwise(F.lit("<region>Anywhere in the World</region>"))
    clean = F.regexp_replace(esc("description"), "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\r]", "")
    summary = F.concat(F.lit("<p>"), clean, F.lit("</p>"))
    return F.concat(F.lit("<item><title>"), x(F.concat("company", F.lit(": "), "title", F.lit(" at "), "company")),
                    F.lit("</title><link>"), x("url"), F.lit("</link><guid>"), x("url"), F.lit("</guid><description>"),
                    x(summary), F.lit("</description>"), author, region, pub, F.lit("</item>"))


def rss_feeds(postings: DataFrame) -> DataFrame:
    """RSS documents for the feed board."""
    items = (postings.filter(F.col("source") == "weworkremotely")
                     .select((F.col("seq") / (PAGE_ITEMS * 9)).cast("long").alias("_pg"), "seq", rss_item().alias("_i")))
    g = items.groupBy("_pg").agg(F.array_sort(F.collect_list(F.struct("seq", "_i"))).alias("_items"))
    return g.select(F.lit(1).alias("role_id"), F.lit("weworkremotely").alias("source"), F.lit(0).alias("search_cell"),
                    F.col("_pg").alias("payload_id"),
                    F.concat(F.lit("<rss><channel><title>Programming jobs</title>"),
                             F.array_join(F.transform("_items", lambda x_: x_["_i"]), ""),
                             F.lit("</channel></rss>")).alias("body"))


def write_feed_file(postings: DataFrame, path: str) -> None:
    """All entries of the feed board as one feed file."""
    rows = postings.filter(F.col("source") == "weworkremotely").select("seq", rss_item().alias("value"))
    ends = postings.sparkSession.createDataFrame(
        [(-1, "<rss><channel><title>Programming jobs</title>"), ((1 << 63) - 1, "</channel></rss>")], "seq long, value string")
    rows.unionByName(ends).repartition(1).sortWithinPartitions("seq").select("value").write.text(path)
