"""Addresses, links, images and identifiers: Column in, Column out. Nulls give nulls, or false where a rule is asked."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rules that results must agree on, in the order in which they are tried.
IMAGE_EXTENSIONS = (".jpg", ".jpeg", ".png", ".gif", ".svg", ".webp", ".bmp", ".ico", ".avif", ".apng", ".tiff", ".tif")
STATIC_EXTENSIONS = (".css", ".js", ".woff", ".woff2", ".ttf", ".eot", ".otf", ".map", ".jsonld", ".xml")
SENSITIVE_PATHS = (
    "/login", "/signin", "/signup", "/sign-in", "/sign-up", "/auth", "/oauth", "/session", "/cookie", "/account", "/profile", "/settings", "/admin", "/dashboard",
    "/billing", "/checkout", "/privacy", "/terms", "/tos",
)
SKIPPED_LINKS = (
    "/login", "/signin", "/signup", "/sign-in", "/sign-up", "/register", "/auth", "/oauth", "/privacy", "/terms", "/tos", "/legal", "/jobs?", "/careers?", "/hiring", "/recruit",
    "/advertise?", "/sponsor", "/share", "/rss", "/feed", "/subscribe", "/comment", "/reply", "avatar", "logo", "favicon", "icon",
    "\\.(jpg|jpeg|png|gif|svg|webp|ico|css|js|woff2?|ttf|eot)(\\?|$|#)", "^#", "^javascript:", "^mailto:", "^tel:", "/cdn-cgi/", "/__/", "/wp-json/", "/wp-admin/",
    "facebook\\.com", "twitter\\.com", "x\\.com", "linkedin\\.com", "instagram\\.com", "youtube\\.com", "tiktok\\.com",
)
PRIORITY_LINKS = (
    "github\\.com/[^/]+/[^/]+$", "github\\.com/[^/]+/[^/]+/blob/.*\\.md$", "github\\.com/[^/]+/[^/]+/tree/", "github\\.com/[^/]+/[^/]+/raw/", "readme\\.md$", "docs?/", "examples?/",
    "arxiv\\.org/(abs|pdf)/", "openreview\\.net/", "paperswithcode\\.com/", "doi\\.org/", "scholar\\.google\\.", "semanticscholar\\.org/", "python\\.org/", "pypi\\.org/",
    "npmjs\\.com/", "rust-lang\\.org/", "golang\\.org/", "blog\\.", "dev\\.to/", "medium\\.com/", "docs\\.", "documentation", "guide", "tutorial", "example", "sample",
    "awesome-", "/awesome/", "wikipedia\\.org/wiki/", "stackoverflow\\.com/", "stackexchange\\.com/",
)
SECRET_PARAMS = (
    "token", "access_token", "refresh_token", "auth", "authorization", "api_key", "apikey", "secret", "session", "sessionid", "device_id", "user_id", "uid", "hkey", "sign",
    "signature", "password", "passwd", "pwd",
)
LAZY_ATTRIBUTES = ("data-src", "data-original", "data-lazy-src", "data-actualsrc", "data-echo", "data-url", "src")
TRACKING_IMAGE = "(?i)(pixel|spacer|blank\\.|1x1|tracking|beacon|impression|shields\\.io|badge\\.svg|badgen\\.net|herokuapp\\.com/badge|favicon)"
VIDEO_FILE = "(?i)\\.(mp4|webm|mov|m4v|mkv|flv|ogv)$"
VIDEO_PLATFORM = (
    "(?i)((?:www\\.|m\\.)?youtube\\.com/(?:watch\\?|embed/|shorts/|v/)|youtu\\.be/|(?:www\\.)?bilibili\\.com/video/|player\\.bilibili\\.com/player\\.html|(?:www\\.)?vimeo\\.com/\\d+"
    "|player\\.vimeo\\.com/video/|(?:twitter|x)\\.com/[^/]+/status/\\d+|(?:www\\.)?tiktok\\.com/@[^/]+/video/|\\.m3u8(?:\\?|$))"
)
REPOSITORY = {
    "raw": "^https?://raw\\.githubusercontent\\.com/([^/]+)/([^/]+)/([^/]+)/(.+)$",
    "blob": "^https?://github\\.com/([\\w.-]+)/([\\w.-]+)/blob/([^/]+)/(.+)$",
    "tree": "^https?://github\\.com/([\\w.-]+)/([\\w.-]+)/tree/([^/]+)/(.+)$",
    "repo": "^https?://github\\.com/([\\w.-]+)/([\\w.-]+?)(?:\\.git)?/?$",
}
# The first bytes of image files, as hex patterns.
MAGIC = (
    (".jpg", "^FFD8FF"), (".png", "^89504E470D0A1A0A"), (".gif", "^47494638"), (".webp", "^52494646(..){0,9}57454250"), (".avif", "^(..){4}667479706176(6966|6973)"),
    (".svg", "^(20|09|0A|0D|0B|0C)*(3C737667|3C3F786D6C)"),
)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def origin(url: Column) -> Column:
    return F.regexp_extract(url, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*:(?://[^/?#]*)?([^?#]*)", 1)


def query_text(url: Column) -> Column:
    return F.regexp_extract(url, "^[^?#]*\\?([^#]*)", 1)


def first_rule(text: Column, rules: tuple[str, ...]) -> Column:
    """The first rule found in the text, else null."""
    return F.coalesce(*[F.when(text.rlike(r), F.lit(r)) for r in rules])


def sensitive_rule(url: Column) -> Column:
    """The first private-area rule that the path matches, else null."""
    return first_rule(F.lower(path(url)), SENSITIVE_PATHS)


def skip_reason(url: Column) -> Column:
    """Why a link isn't followed: its scheme, its file type or a rule; else null."""
    low = F.lower(path(url))
    asked = F.lower(query_text(url))
    ext = F.regexp_extract(low, "[^/](\\.[^./]+)$", 1)
    whole = F.concat(low, F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise(""))
    by_rule = first_rule(whole, SKIPPED_LINKS)
    return (
        F.when(~scheme(url).isin("http", "https"), F.concat(F.lit("scheme: "), scheme(url)))
        .when(ext.isin(*STATIC_EXTENSIONS, *IMAGE_EXTENSIONS), F.concat(F.lit("static: "), ext)).when(by_rule.isNotNull(), F.concat(F.lit("rule: "), by_rule))
    )


def priority_rule(url: Column) -> Column:
    """The first rule that makes a link worth following early, else null."""
    return first_rule(F.lower(url), PRIORITY_LINKS)


def repository(url: Column) -> Column:
    """kind, owner, repo, branch and path of a code-host address; null for others."""
    found = [
        F.when(url.rlike(p), F.struct(
            F.lit(kind).alias("kind"), F.regexp_extract(url, p, 1).alias("owner"), F.regexp_extract(url, p, 2).alias("repo"),
            (F.lit("main") if kind == "repo" else F.regexp_extract(url, p, 3)).alias("branch"), (F.lit("") if kind == "repo" else F.regexp_extract(url, p, 4)).alias("path"),
        ))
        for kind, p in REPOSITORY.items()
    ]
    return F.coalesce(*found)


def site_class(url: Column) -> Column:
    return F.when(url.contains("github.com"), "github").when(url.contains("mp.weixin.qq.com"), "wechat").when(url.contains("arxiv.org"), "academic").otherwise("webpage")


def redacted_query(url: Column) -> Column:
    """The address with secret parameters' values masked, the first value of each key, keys in order; values as written."""
    pairs = F.transform(
        F.filter(F.split(query_text(url), "&"), lambda p: p != ""), lambda p: F.struct(F.regexp_extract(p, "^([^=]*)", 1).alias("k"), F.regexp_extract(p, "^[^=]*=(.*)$", 1).alias("v"))
    )
    first = F.filter(pairs, lambda p, i: F.array_position(F.transform(pairs, lambda q: q["k"]), p["k"]) == i + 1)
    shown = F.transform(first, lambda p: F.concat(p["k"], F.lit("="), F.when(F.lower(p["k"]).isin(*SECRET_PARAMS), "***REDACTED***").otherwise(p["v"])))
    before, after = F.regexp_extract(url, "^([^?#]*)", 1), F.regexp_extract(url, "(#.*)$", 1)
    return F.when(query_text(url) == "", url).otherwise(F.concat(before, F.lit("?"), F.array_join(shown, "&"), after))


def content_class(content_type: Column) -> Column:
    kind = F.lower(F.trim(F.split(content_type, ";")[0]))
    return F.when(kind.contains("json"), "json").when(kind.contains("html"), "html").when(kind == "text/plain", "plain").otherwise("other")


def resolved(base: Column, href: Column) -> Column:
    """An absolute address of a link on a page; dot segments are kept as written."""
    folder = F.regexp_extract(F.regexp_replace(base, "[?#].*$", ""), "^([A-Za-z][A-Za-z0-9+.-]*://[^/]*(?:/.*/|/)?)", 1)
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href)).when(href.startswith("/"), F.concat(origin(base), href))
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href)).otherwise(F.concat(folder, F.when(folder.endswith("/"), "").otherwise("/"), href))
    )


def attribute(tag: Column, name: str) -> Column:
    """The value of a double-quoted attribute of one tag, empty where it has none."""
    return F.regexp_extract(tag, f'\\s{name}="([^"]*)"', 1)


def largest_source(srcset: Column) -> Column:
    """The widest entry of a source set, the first one of equals; empty for none."""
    parts = F.filter(F.split(srcset, ","), lambda p: F.trim(p) != "")
    sized = F.transform(parts, lambda p, i: F.struct(
        F.coalesce(F.regexp_extract(p, "^\\s*\\S+\\s+([0-9]+)(?:\\.[0-9]*)?w(?:\\s|$)", 1).try_cast("int"), F.lit(0)).alias("w"), (-i).alias("at"), F.regexp_extract(p, "^\\s*(\\S+)", 1).alias("u")))
    return F.coalesce(F.array_max(sized)["u"], F.lit(""))


def placeholder_image(src: Column) -> Column:
    low = F.lower(src)
    return low.startswith("data:") | low.contains("placeholder") | low.contains("/loading.") | low.endswith("blank.gif")


def best_image(tag: Column, base: Column) -> Column:
    """The first usable address of an image tag: widest source, lazy attributes, plain source; empty for none."""
    srcset = F.coalesce(F.nullif(attribute(tag, "srcset"), F.lit("")), attribute(tag, "data-srcset"))
    candidates = F.array(largest_source(srcset), *[attribute(tag, a) for a in LAZY_ATTRIBUTES])
    usable = F.filter(F.transform(candidates, F.trim), lambda u: (u != "") & ~placeholder_image(u))
    return F.when(F.size(usable) > 0, resolved(base, F.get(usable, F.lit(0)))).otherwise("")


def decorative_image(tag: Column, src: Column) -> Column:
    """A tracking or badge address, or a width or height of three pixels or fewer."""
    small = [F.coalesce(F.regexp_extract(attribute(tag, a), "^\\s*([0-9]{1,9})[px]*\\s*$", 1).try_cast("int") <= 3, F.lit(False)) for a in ("width", "height")]
    return src.rlike(TRACKING_IMAGE) | small[0] | small[1]


def sniffed_extension(head_hex: Column, fallback: Column) -> Column:
    """The file type that the first bytes (as hex) show, else the given one."""
    return F.coalesce(*[F.when(head_hex.rlike(p), F.lit(ext)) for ext, p in MAGIC], fallback)


def video_kind(url: Column) -> Column:
    """direct for video files, platform for known players, else null."""
    return F.when(F.regexp_replace(url, "[?#].*$", "").rlike(VIDEO_FILE), "direct").when(url.rlike(VIDEO_PLATFORM), "platform")


def normal_doi(doi: Column) -> Column:
    """A bare identifier: no resolver address or label, its prefix in lower case."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(doi), "(?i)^https?://(dx\\.)?doi\\.org/", ""), "(?i)^doi:\\s*", ""))
    return F.when(bare.contains("/"), F.concat(F.lower(F.regexp_extract(bare, "^([^/]*)", 1)), F.regexp_extract(bare, "^[^/]*(/.*)$", 1))).otherwise(F.lower(bare))
