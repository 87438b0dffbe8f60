"""Scholarly pages: identifiers, signals, verdict, work type, enrichment status; all as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of identifiers. A lookahead is written as a class, so that more engines read it.
DOI = "(?i)\\b(10\\.\\d{4,}(?:\\.\\d+)?/\\S+[^\\s\"'])\\b"
ARXIV = "(?i)\\b(arXiv:\\s*\\d{4}\\.\\d{4,}(?:v\\d+)?)\\b"
PMID = "(?i)\\b(PMID:\\s*\\d{5,8})\\b"

# Sites of scholarly works.
ACADEMIC = (
    "arxiv.org", "pubmed.ncbi.nlm.nih.gov", "doi.org", "sci-hub", "scholar.google.com", "semanticscholar.org", "researchgate.net", "academia.edu", "cnki.net", "wanfangdata.com", "cqvip.com",
    "ieeexplore.ieee.org", "dl.acm.org", "springer.com", "sciencedirect.com", "tandfonline.com", "wiley.com", "nature.com", "science.org", "cell.com", "lancet.com", "nejm.org", "jamanetwork.com",
    "bmj.com", "ssrn.com", "repec.org", "nber.org", "thesis", "dissertation",
)
# Words of a paper's structure.
STRUCTURE_CN = ("摘要", "关键词", "参考文献", "引用文献", "作者简介", "基金项目", "收稿日期", "中图分类号", "通讯作者", "第一作者")
STRUCTURE_EN = ("abstract", "keywords", "references", "bibliography", "introduction", "methodology", "method", "results", "discussion", "conclusion", "acknowledgments", "corresponding author", "funding")
# What kind of page isn't a single work, whatever else it holds.
HARD = (
    ("journal_toc", "(?i)^(?:本期)?目录\\s*$"),
    ("journal_toc", "(?i)^table\\s+of\\s+contents\\s*$"),
    ("journal_toc", "(?i)^(?:vol(?:ume)?\\.?\\s*\\d+.*?(?:issue|no\\.?)\\s*\\d+.*?(?:table\\s+of\\s+)?contents?)"),
    ("journal_toc", "(?i)^(?:第\\d+卷.*?第\\d+期.*?(?:目录|总目录))"),
    ("search_results", "(?i)^检索结果"),
    ("search_results", "(?i)^search\\s+results?\\s+(?:for|：)"),
    ("search_results", "(?i)^\\d+\\s+results?\\s+found"),
    ("paper_aggregation", "(?i)(?:最新|top|recent)\\s*(?:论文|papers?|articles?)\\s*(?:推荐|列表|list)"),
    ("paper_aggregation", "(?i)^\\s*(?:\\[\\d+\\]\\s+.+\\n){3,}"),
    ("software_doc", "(?i)^(?:#+\\s*)?(?:readme|changelog|license)(?:\\s*$|\\s*\\n)"),
    ("software_doc", "(?i)(?:npm\\s+(?:install|run|test)|pip\\s+install|gem\\s+install|cargo\\s+build)"),
)
# Words that speak against a work without ruling it out.
SOFT_TITLE_CN = ("新闻", "报道", "快讯", "通知", "公告")
SOFT_TITLE_EN = ("news", "press release", "blog", "newsletter", "announcement")
SOFT_BODY = (("news_article", "(?i)news\\s*article"), ("press_release", "(?i)press\\s*release"), ("blog_post", "(?i)blog\\s*post"), ("newsletter", "(?i)newsletter"))


def identifiers(text: Column) -> dict[str, Column]:
    """The first identifier of each kind in a text, null without one."""
    first = lambda p: F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), p, 1), F.lit(""))
    return {"doi": F.regexp_replace(first(DOI), "\\.+$", ""), "arxiv_id": first(ARXIV), "pmid": first(PMID)}


def _first(pairs: list[tuple[Column, Column | str]]) -> Column:
    out = F.lit(None).cast("string")
    for condition, value in reversed(pairs):
        out = F.when(condition, F.lit(value) if isinstance(value, str) else value).otherwise(out)
    return out


def strong_signals(found: dict[str, Column], declared: Column, source_url: Column) -> Column:
    """Names of the strong signals, in order."""
    low = F.lower(F.coalesce(source_url, F.lit("")))
    academic = F.exists(F.array(*map(F.lit, ACADEMIC)), lambda d: low.contains(d))
    named = (("doi_identified", found["doi"].isNotNull()), ("arxiv_id", found["arxiv_id"].isNotNull()), ("pmid", found["pmid"].isNotNull()), ("frontmatter_type_literature", declared), ("academic_source_url", academic))
    return F.array_compact(F.array(*[F.when(c, n) for n, c in named]))


def medium_signals(body: Column, bibliographic: Column, volume_fields: Column, has_issn: Column) -> Column:
    """Names of the medium signals; ``bibliographic`` and ``volume_fields`` are numbers of given fields."""
    low = F.lower(body)
    words = lambda t, some: F.size(F.filter(F.array(*map(F.lit, some)), lambda w: t.contains(w)))
    marks = words(body, STRUCTURE_CN) + words(low, STRUCTURE_EN)
    return F.array_compact(
        F.array(
            F.when(bibliographic >= 3, F.concat(F.lit("bibliographic_fields_"), bibliographic)),
            F.when(volume_fields >= 1, F.concat(F.lit("volume_issue_page_"), volume_fields)),
            F.when(has_issn, F.lit("has_issn")),
            F.when(marks >= 2, F.concat(F.lit("scholarly_structure_"), F.least(marks, F.lit(5)))),
        )
    )


def hard_exclusion(title: Column, body: Column) -> Column:
    """The first page kind that rules a work out, else null."""
    return _first([(F.lower(title).rlike(p) | body.rlike(p), kind) for kind, p in HARD])


def soft_exclusions(title: Column, body: Column) -> Column:
    """The first title word and the first body pattern that speak against a work."""
    by_title = _first([*[(title.contains(w), f"title_cn:{w}") for w in SOFT_TITLE_CN], *[(F.lower(title).contains(w), f"title_en:{w}") for w in SOFT_TITLE_EN]])
    return F.array_compact(F.array(by_title, _first([(body.rlike(p), f"content:{kind}") for kind, p in SOFT_BODY])))


def verdict(strong: Column, medium: Column, hard: Column, soft: Column, declared: Column, disabled: Column) -> Column:
    """(is_scholarly, hundredths): what the user says comes first, then page kinds, strong and medium signals.

    Confidence is counted in hundredths, so that no engine rounds it its own way.
    """
    n, m, against = F.size(strong), F.size(medium), F.size(soft) > 0
    out = lambda yes, c: F.struct(yes.alias("is_scholarly"), c.cast("int").alias("hundredths"))
    less = lambda c, by, least: F.when(against, F.greatest(c - by, F.lit(least))).otherwise(c)
    said = less(F.when(n > 0, F.least(95 + (n - 1) * 3, F.lit(100))).otherwise(95), 10, 85)
    firm = less(F.least(F.least(90 + (n - 1) * 5, F.lit(100)) + m * 2, F.lit(100)), 15, 70)
    several, one = less(F.least(60 + m * 10, F.lit(89)), 20, 40), less(F.lit(60), 20, 40)
    no = out(F.lit(False), F.lit(0))
    return (
        F.when(disabled, no).when(declared, out(F.lit(True), said)).when(hard.isNotNull(), no).when(n > 0, out(F.lit(True), firm))
        .when(m >= 2, out(several >= 70, several)).when(m == 1, out(one >= 60, one)).otherwise(no)
    )


def work_type(kind: Column, arxiv_id: Column, body: Column) -> Column:
    """What sort of work it is: by its own type, its identifier, then words of its body."""
    kind, low = F.lower(F.coalesce(kind, F.lit(""))), F.lower(body)
    return (
        F.when(kind.isin("journal-article", "article-journal", "journal_article"), "article-journal").when(kind.isin("paper-conference", "conference", "proceedings-article"), "paper-conference")
        .when(kind.contains("thesis") | kind.contains("dissertation"), "thesis").when(kind.isin("preprint", "article"), "preprint").when(kind.isin("book", "monograph"), "book")
        .when(kind.isin("chapter", "book-chapter"), "chapter").when(kind.isin("report", "technical-report"), "report").when(arxiv_id.isNotNull(), "preprint")
        .when(low.contains("doctoral dissertation") | low.contains("master's thesis") | low.contains("ph.d. thesis"), "thesis")
        .when(low.contains("conference") & low.contains("proceedings"), "paper-conference").otherwise("article-journal")
    )


def auto_enrich(found: Column, strong: Column, declared: Column, disabled: Column, threshold: int = 90) -> Column:
    """Never what the user disabled, always what they declared, else what is certain enough with a strong signal."""
    return F.when(disabled, False).when(declared, True).otherwise(found["is_scholarly"] & (found["hundredths"] >= threshold) & (F.size(strong) > 0))


def page_status(locked: Column, found: Column, enrich: Column, doi: Column) -> Column:
    """Why a page isn't enriched, or that it is."""
    return F.when(locked, "locked").when(~found["is_scholarly"], "not_scholarly").when(~enrich, "below_threshold").when(F.coalesce(doi, F.lit("")) == "", "no_doi").otherwise("enriched")


def csl_json(work: dict[str, Column]) -> Column:
    """A work in the citation processors' JSON form; empty fields are left out."""
    some = lambda c: F.nullif(c, F.lit(""))
    person = F.transform(work["authors"], lambda a: F.struct(some(a["family"]).alias("family"), some(a["given"]).alias("given")))
    fields = (
        ("id", work["doi"]), ("type", F.coalesce(some(work["pub_type"]), F.lit("article-journal"))), ("title", some(work["title"])), ("container-title", some(work["journal_name"])), ("volume", some(work["volume"])),
        ("issue", some(work["issue"])), ("page", some(work["page"])), ("DOI", some(work["doi"])), ("ISSN", F.coalesce(some(work["issn_l"]), some(work["issn"]))), ("publisher", some(work["publisher"])), ("author", person),
        ("issued", F.struct(F.array(F.array(work["year"])).alias("date-parts"))),
    )
    return F.to_json(F.struct(*[c.alias(n) for n, c in fields]))
