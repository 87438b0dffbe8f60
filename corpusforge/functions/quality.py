"""Quality scores of a text: Column in, Column out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.functions.text import visible_text, with_value

# Navigation terms that results must agree on.
NAV_CN = (
    "首页", "回到首页", "返回首页", "登录", "注册", "立即登录", "立即注册", "下载App", "下载APP", "下载客户端", "打开App", "返回顶部", "回到顶部", "上一篇", "下一篇", "上一页", "下一页", "隐私政策", "隐私条款", "隐私声明", "用户协议", "服务条款", "使用协议", "联系我们",
    "关于我们", "商务合作", "版权", "版权所有", "保留所有权利", "搜索", "导航", "菜单", "分享到", "分享至", "转发", "收藏", "点赞", "评论", "举报", "扫一扫", "扫码", "二维码", "热门推荐", "相关推荐", "为你推荐", "广告", "推广",
)
NAV_EN = (
    "home", "back to home", "login", "log in", "sign in", "signin", "register", "sign up", "signup", "create account", "download app", "open in app", "get the app", "back to top",
    "scroll to top", "previous", "next", "prev", "next page", "privacy policy", "privacy", "privacy statement", "terms of service", "terms of use", "terms and conditions", "contact us",
    "about us", "about", "copyright", "all rights reserved", "search", "navigation", "menu", "sitemap", "share", "tweet", "share to", "save", "bookmark", "like", "comment", "report",
    "advertisement", "sponsored", "promoted", "subscribe", "newsletter", "follow us", "cookie", "cookie policy", "cookie settings", "dark mode", "light mode", "theme",
)
#: Windows of these characters alone aren't counted as content.
MARKS = "[\\s,;:!?.，。；：！？、\"“”‘’'「」『』【】《》（）\\[\\]{}\\-—…·]"


def navigation_terms(text: Column) -> Column:
    """The navigation terms that occur in a text, as a struct of two lists; no line can hold others."""
    held = lambda x, terms: F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: x.contains(t))
    return F.struct(held(text, NAV_CN).alias("cn"), with_value(F.lower(text), lambda low: held(low, NAV_EN)).alias("en"))


def _covered(line: Column, terms: Column) -> Column:
    return F.aggregate(terms, F.lit(0), lambda acc, t: acc + F.when(line.contains(t), F.length(line) - F.length(F.replace(line, t, F.lit("")))).otherwise(0))


def navigation_line(line: Column, terms: Column) -> Column:
    """Navigation terms (those of the line's text) cover half of the line or more."""
    share = lambda bare: (_covered(bare, terms["cn"]) + with_value(F.lower(bare), lambda low: _covered(low, terms["en"]))) / F.greatest(F.length(bare), F.lit(1))
    return with_value(F.trim(line), lambda bare: (F.length(bare) > 0) & (share(bare) >= 0.5))


def navigation_ratio(text: Column, terms: Column | None = None) -> Column:
    """Navigation lines among the lines that aren't blank."""
    if terms is None:
        return with_value(navigation_terms(text), lambda t: navigation_ratio(text, t))
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    share = lambda kept: F.when(F.size(kept) == 0, 0.0).otherwise(F.size(F.filter(kept, lambda x: navigation_line(x, terms))) / F.size(kept))
    return with_value(lines, share)


def duplication_ratio(text: Column, width: int = 4000) -> Column:
    """Repeated 5-character windows among those of the first ``width`` characters (the width is the feature), marks alone left out."""
    pattern = MARKS

    def repeated(heads: pd.Series) -> pd.Series:
        import re

        mark, marks = re.compile(pattern, re.ASCII).fullmatch, {}

        def ratio(head):
            if head is None:
                return None
            for c in set(head) - marks.keys():
                marks[c] = mark(c) is not None
            held = [head[i : i + 5] for i in range(len(head) - 4)]
            held = [w for w in held if not (marks[w[0]] and marks[w[4]] and all(marks[c] for c in w))]
            return (len(held) - len(set(held))) / len(held) if held else 0.0

        return heads.map(ratio)

    repeated.__annotations__ = {"heads": pd.Series, "return": pd.Series}
    return F.pandas_udf(repeated, "double")(F.substring(text, 1, width))


def language_ratio(text: Column) -> Column:
    """CJK characters and ASCII letters among those that aren't blank."""
    dense = F.length(F.regexp_replace(text, "\\s", ""))
    letters = F.length(F.regexp_replace(text, "[^A-Za-z\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{20000}-\\x{2A6DF}\\x{F900}-\\x{FAFF}]", ""))
    return F.when(dense == 0, 0.0).otherwise(letters / dense)


def length_score(n: Column) -> Column:
    """0 to 30, linear between 0, 200, 500, 2000 and 5000 characters."""
    return (
        F.when(n <= 0, 0.0).when(n < 200, 5.0 * (n / 200)).when(n < 500, 5.0 + 10.0 * ((n - 200) / 300)).when(n < 2000, 15.0 + 10.0 * ((n - 500) / 1500))
        .otherwise(25.0 + 5.0 * F.least((n - 2000) / 3000, F.lit(1.0)))
    )


def language_score(r: Column) -> Column:
    """0 to 25, linear between 0, 0.25, 0.5, 0.75 and 1."""
    return (
        F.when(r <= 0, 0.0).when(r < 0.25, 5.0 * (r / 0.25)).when(r < 0.5, 5.0 + 10.0 * ((r - 0.25) / 0.25)).when(r < 0.75, 15.0 + 7.0 * ((r - 0.5) / 0.25))
        .otherwise(22.0 + 3.0 * F.least((r - 0.75) / 0.25, F.lit(1.0)))
    )


def excess_penalty(ratio: Column, most: float, weight: float = 25.0) -> Column:
    """0 up to ``most``, then linear to ``weight`` at 1."""
    return F.when(ratio <= most, 0.0).otherwise((F.least(ratio, F.lit(1.0)) - most) / (1.0 - most) * weight)


# Patterns of special pages that results must agree on.
SPECIAL = {
    "script_placeholder": (
        "请(?:开启|启用|打开)[Jj]ava[Ss]cript", "您的浏览器(?:不支持|需要|必须)", "请(?:使用|升级).*浏览器", "JavaScript\\s*(?:未启用|被禁用|is\\s+disabled)",
        "(?i)JavaScript\\s+is\\s+(?:required|not\\s+available|disabled)", "(?i)Please\\s+enable\\s+JavaScript", "(?i)This\\s+(?:page|site)\\s+requires?\\s+JavaScript",
        "(?i)Your\\s+browser\\s+(?:does\\s+not\\s+support|is\\s+not\\s+supported)",
    ),
    "login": (
        "登录后(?:查看|可见|阅读|浏览)", "请先登录", "登录(?:才能|即可|后方可)", "您需要登录", "(?i)(?:Sign|Log)\\s+in\\s+to\\s+(?:view|read|continue|access)",
        "(?i)Please\\s+(?:sign|log)\\s+in", "(?i)You\\s+(?:need|must)\\s+(?:to\\s+)?(?:sign|log)\\s+in", "(?i)(?:Sign|Log)\\s+in\\s+required",
    ),
    "captcha": (
        "验证码", "安全验证", "人机验证", "(?i)CAPTCHA", "(?i)verify\\s+(?:you\\s+are|that\\s+you\\s+are)\\s+(?:a\\s+)?human", "(?i)security\\s+(?:verification|check)",
        "(?i)prove\\s+you\\s+(?:are|'re)\\s+(?:human|not\\s+a\\s+robot)", "请输入(?:验证码|图片中的|图中的)", "滑动验证", "点击(?:验证|确认)",
    ),
    "not_found": (
        "(?:页面|内容|文章)(?:不存在|已删除|已下架|已失效|未找到)", "(?i)Page\\s+(?:not\\s+found|does\\s+not\\s+exist)", "(?i)404\\s*(?:Not\\s+Found|Page)?",
        "(?i)Content\\s+(?:not\\s+found|removed|deleted|unavailable)", "链接已失效",
    ),
}
# Issue codes in report order, and those that make a text incomplete at once.
ISSUES = (
    "title_missing", "text_too_short", "too_few_paragraphs", "navigation_ratio_high", "duplication_ratio_high", "natural_language_ratio_low",
    "script_placeholder", "login_required", "captcha_detected", "menu_or_footer_only", "possibly_truncated",
)
FATAL = ("script_placeholder", "login_required", "captcha_detected")
# Markdown and HTML marks taken out of a text, in this order.
NOISE = (
    ("!\\[[^\\]]*\\]\\([^)]*\\)", ""), ("```[^`]*```", " "), ("`[^`]+`", " "), ("\\[([^\\]]*)\\]\\([^)]*\\)", "$1"), ("\\*\\*(.+?)\\*\\*", "$1"), ("__(.+?)__", "$1"),
    ("\\*(.+?)\\*", "$1"), ("_(.+?)_", "$1"), ("~~(.+?)~~", "$1"), ("(?m)^#{1,6}\\s+", ""), ("<[^>]+>", " "), ("&[a-zA-Z]+;|&#[0-9]+;", " "), ("https?://\\S+", " "),
    ("[ \\t]+", " "), ("\\n{3,}", "\n\n"), ("^\\s+|\\s+$", ""),
)
SENTENCE_END = "[。！？.!?…\"”'》)】]\\s*$"


def plain_text(text: Column) -> Column:
    """Readable text without Markdown and HTML marks; null gives an empty text."""
    out = F.coalesce(text, F.lit(""))
    for pattern, put in NOISE:
        out = F.regexp_replace(out, pattern, put)
    return out


def special_ratio(text: Column, kind: str) -> Column:
    """Characters matched by the patterns of one kind of special page, as a share of the text, 1 at most."""
    found = [F.aggregate(F.regexp_extract_all(text, F.lit(p), F.lit(0)), F.lit(0), lambda n, m: n + F.length(m)) for p in SPECIAL[kind]]
    return F.least(sum(found[1:], found[0]) / F.greatest(F.length(text), F.lit(1)), F.lit(1.0))


def paragraphs(text: Column) -> Column:
    return F.split(text, "\\n\\s*\\n")


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, "^\\s+|\\s+$", "")


def valid_paragraph(p: Column, terms: Column) -> Column:
    """20 characters or more, not a bare address, and navigation lines at most three fifths of several lines."""
    menu = lambda lines: (F.size(lines) > 1) & (F.size(F.filter(lines, lambda x: navigation_line(x, terms))) / F.size(lines) > 0.6)
    return with_value(stripped(p), lambda bare: (F.length(bare) >= 20) & ~bare.rlike("^https?://\\S+$") & ~with_value(F.split(bare, "\\n"), menu))


def n_paragraphs(text: Column) -> Column:
    return F.when(F.length(text) == 0, 0).otherwise(F.size(paragraphs(text)))


def n_valid_paragraphs(text: Column, terms: Column | None = None) -> Column:
    if terms is None:
        return with_value(navigation_terms(text), lambda t: n_valid_paragraphs(text, t))
    return F.size(F.filter(paragraphs(text), lambda p: valid_paragraph(p, terms)))


def n_headings(text: Column) -> Column:
    return F.regexp_count(text, F.lit("(?m)^#{1,6}\\s+\\S"))


def n_code_blocks(text: Column) -> Column:
    return F.floor(F.regexp_count(text, F.lit("```")) / 2).cast("int")


def truncated(text: Column) -> Column:
    """The last paragraph is under a quarter of the others' mean length, or over 20 characters without a sentence's end."""

    def judged(parts: Column) -> Column:
        last = F.element_at(parts, -1)
        before = F.aggregate(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.lit(0), lambda n, p: n + F.length(p)) / (F.size(parts) - 1)
        open_end = (F.length(last) > 20) & ~last.rlike(SENTENCE_END)
        return F.when(F.size(parts) < 2, False).otherwise((F.length(last) / before < 0.25) | open_end)

    return with_value(F.filter(F.transform(paragraphs(text), stripped), lambda p: p != ""), judged)


def paragraph_score(n: Column) -> Column:
    """0 to 25 by the number of valid paragraphs."""
    return (
        F.when(n <= 0, 0.0).when(n == 1, 5.0).when(n == 2, 10.0).when(n <= 5, 15.0 + 5.0 * ((n - 3) / 3))
        .otherwise(F.least(F.lit(25.0), 20.0 + 5.0 * F.least((n - 6) / 10, F.lit(1.0))))
    )


def structure_score(titled: Column, headings: Column, blocks: Column) -> Column:
    """0 to 20 for a title, headings and code blocks."""
    parts = F.when(titled, 10.0).otherwise(0.0) + F.when(headings >= 1, 5.0).otherwise(0.0) + F.least(F.lit(5.0), blocks * 2.5)
    return F.least(parts, F.lit(20.0))


def special_penalty(ratio: Column, length: Column) -> Column:
    """40 for a short text with over a tenth of special patterns, else linear above three tenths."""
    return F.when((length < 500) & (ratio > 0.1), 40.0).when(ratio > 0.3, (ratio - 0.3) / 0.7 * 40.0).otherwise(0.0)


def special_page(ratio: Column, length: Column) -> Column:
    return (ratio > 0.3) | ((length < 500) & (ratio > 0.1))


def report(rows: DataFrame, title: Column, content: Column, html: Column | None = None) -> DataFrame:
    """Adds the quality report of each row: measures, score (0 to 100), issues and whether the text is complete.

    The longer of the plain content and the visible HTML is judged. Nulls count as empty texts. All
    measures are row expressions, so the report needs no shuffle. They come out of a generator of one row each, so each is
    computed once: filters and projections above can't be merged with what is below it.
    """
    given = F.coalesce(content, F.lit(""))

    def measures(text: Column, terms: Column) -> Column:
        return F.struct(
            F.length(text).alias("analysis_length"), n_paragraphs(text).alias("n_paragraphs"), n_valid_paragraphs(text, terms).alias("n_valid"), n_headings(F.col("_given")).alias("n_headings"),
            n_code_blocks(F.col("_given")).alias("n_code"), navigation_ratio(text, terms).alias("nav_ratio"), language_ratio(text).alias("lang_ratio"),
            special_ratio(text, "script_placeholder").alias("script_ratio"), special_ratio(text, "login").alias("login_ratio"), special_ratio(text, "captcha").alias("captcha_ratio"),
            ((n_paragraphs(text) >= 2) & truncated(text)).alias("cut"),
        )

    text = plain_text(content)
    if html is not None:
        both = F.struct(text.alias("plain"), visible_text(F.coalesce(html, F.lit(""))).alias("seen"))
        text = with_value(both, lambda b: F.when(F.length(b["plain"]) >= F.length(b["seen"]), b["plain"]).otherwise(b["seen"]))
    out = rows.select("*", (F.length(stripped(F.coalesce(title, F.lit("")))) > 0).alias("titled"), given.alias("_given"), F.explode(F.array(text)).alias("_text"))
    out = out.withColumn("dup_ratio", duplication_ratio(F.col("_text")))
    measured = with_value(navigation_terms(F.col("_text")), lambda terms: measures(F.col("_text"), terms))
    out = out.select("*", F.inline(F.array(measured))).drop("_given", "_text")
    n, c = F.col("analysis_length"), F.col
    plus = length_score(n.cast("double")) + paragraph_score(c("n_valid")) + language_score(c("lang_ratio")) + structure_score(c("titled"), c("n_headings"), c("n_code"))
    minus = excess_penalty(c("nav_ratio"), 0.4) + excess_penalty(c("dup_ratio"), 0.35)
    for kind in ("script_ratio", "login_ratio", "captcha_ratio"):
        minus = minus + special_penalty(c(kind), n)
    flags = (
        ~c("titled"), n < 200, c("n_valid") < 1, c("nav_ratio") > 0.4, c("dup_ratio") > 0.35, c("lang_ratio") < 0.25, special_page(c("script_ratio"), n),
        special_page(c("login_ratio"), n), special_page(c("captcha_ratio"), n), (c("n_valid") <= 1) & (c("nav_ratio") > 0.5), c("cut"),
    )
    empty = (n == 0) & ~c("titled")
    issues = F.when(empty, F.array(F.lit("text_too_short"), F.lit("title_missing"))).otherwise(F.array_compact(F.array(*[F.when(f, code) for f, code in zip(flags, ISSUES)])))
    out = out.withColumn("issues", issues).withColumn("score", F.when(empty, 0).otherwise(F.greatest(F.lit(0), F.least(F.lit(100), F.bround(plus - minus).cast("int")))))
    complete = ~F.arrays_overlap("issues", F.array(*[F.lit(f) for f in FATAL])) & (c("score") >= 35) & (n >= 200) & (c("n_valid") >= 1)
    return out.withColumn("complete", complete)
