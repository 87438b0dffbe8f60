"""Files on their way in: class, gate, targets, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusforge.operators.numbering import numbered

# Classes in the order they are tried, with their extensions and words.
CLASSES = {
    "academic_paper": ((".pdf", ".docx"), ("学报", "大学", "哲学", "法律", "历史", "文学", "政治", "经济", "社会", "马克思", "恩格斯", "费尔巴哈", "唯物", "实践", "权利", "journal", "university", "research", "analysis")),
    "coursework": ((".docx", ".pptx", ".pdf"), ("作业", "考试", "课程", "小组", "汇报", "实验", "报告", "答辩")),
    "school_policy": ((".doc", ".docx"), ("规则", "规范", "写作", "论文", "学位", "格式", "要求")),
    "project_ppt": ((".pptx",), ("项目", "方案", "听证会", "模拟", "提案", "策划", "计划")),
    "methodology": ((".md",), ("模式", "框架", "方法", "理念", "架构", "设计", "pattern")),
}
# Sections that each class is filed under; the last is for all others. The second one of methodology is a folder of one
# project there, whose name isn't taken over.
TARGETS = {
    "academic_paper": "wiki/sources/,wiki/concepts/", "coursework": "wiki/sources/,wiki/outputs/", "school_policy": "wiki/sources/,wiki/concepts/",
    "project_ppt": "wiki/sources/,wiki/projects/", "methodology": "wiki/concepts/,wiki/projects/", "": "wiki/sources/",
}
SENSITIVE_NAME = "^(\\.env|id_rsa)"
# What a file's text mustn't hold.
SECRETS = (
    "(?i)(?:api[_-]?key|apikey|api_secret|secret_key)\\s*[=:]\\s*[\"']?[\\w\\-]{20,}[\"']?",
    "(?i)(?:token|access_token|auth_token|bearer)\\s*[=:]\\s*[\"']?[\\w\\-\\.]{20,}[\"']?",
    "(?i)(?:password|passwd|pwd)\\s*[=:]\\s*[\"'][^\"']{3,}[\"']",
    "(?i)(?:private[_-]?key|secret)\\s*[=:]\\s*[\"']?[\\w\\-+/=]{20,}[\"']?",
    "(?i)-----BEGIN (?:RSA |OPENSSH |EC )?PRIVATE KEY-----",
    "(?i)-----BEGIN PGP PRIVATE KEY BLOCK-----",
    "(?i)(?:credential|cred)s?\\s*[=:]\\s*[\"']?[\\w\\-]{10,}[\"']?",
)
SECRET_SAMPLE = "|".join(SECRETS)
IMPORTED = (".pdf", ".docx", ".pptx", ".md", ".txt", ".csv", ".html", ".json", ".xlsx")
LEGACY = (".doc", ".ppt")


def content_class(name: Column, ext: Column, sample: Column) -> Column:
    """The first class whose extension fits and one of whose words stands in the name or the sample."""
    low = F.lower(F.concat(name, F.lit("\n"), sample))
    fits = [(F.lower(ext).isin(*exts) & low.rlike("|".join(words)), c) for c, (exts, words) in CLASSES.items()]
    out = F.when(fits[0][0], fits[0][1])
    for hit, c in fits[1:]:
        out = out.when(hit, c)
    return out.otherwise("unknown")


def targets(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind == c, F.lit(t)) for c, t in TARGETS.items() if c], F.lit(TARGETS[""]))


def pruned(path: Column) -> Column:
    """Lies in a hidden or generated folder."""
    return path.rlike("(^|/)(\\.[^/]+|node_modules|__pycache__)/")


def processed_manifest(files: DataFrame) -> DataFrame:
    """(name, size_kb, processed_at): the entry of each processed file."""
    return files.select("name", F.round(F.col("length") / 1024.0, 1).alias("size_kb"), F.current_timestamp().alias("processed_at"))


def gate() -> Column:
    """Why a file isn't taken in, or accepted: pruned folder, sensitive name, type, size, secret in its sample."""
    return (
        F.when(pruned(F.col("path")), "pruned").when(F.col("name").rlike(SENSITIVE_NAME), "sensitive_name").when(F.col("ext").isin(*LEGACY), "legacy_type")
        .when(~F.col("ext").isin(*IMPORTED), "unsupported_type").when(F.col("size_bytes") > 10485760, "too_large").when(F.col("sample").rlike(SECRET_SAMPLE), "secret_in_text").otherwise("accepted")
    )


def safe_names(files: DataFrame) -> DataFrame:
    """Files of one name get _1, _2 ... before the extension, by doc_id; the first keeps its name."""
    stem = F.expr("left(name, length(name) - length(ext))")
    rows = numbered(files, ["name"], ["doc_id"], "n").withColumn("again", F.col("n") - 1)
    return rows.withColumn("safe_name", F.when(F.col("again") == 0, F.col("name")).otherwise(F.concat(stem, F.lit("_"), F.col("again"), F.col("ext"))))


EXTRACTED = (".pdf", ".docx", ".pptx", ".xlsx")


def routed(files: DataFrame) -> DataFrame:
    """Files with the route they take (found, is_file, gate, full_mode, extracted given) and whether another reader must follow."""
    c = F.col
    refused = ~c("gate").isin("accepted", "legacy_type", "unsupported_type")
    route = (
        F.when(~c("found"), "file_not_found").when(~c("is_file"), "not_a_file").when(refused, "import_failed").when(~c("full_mode"), "safe_mode").when(c("ext") == ".doc", "legacy_doc_unsupported")
        .when(~c("ext").isin(*EXTRACTED), "direct_read").when(c("extracted"), "extracted").otherwise("needs_fallback")
    )
    return files.withColumn("route", route).withColumn("fallback_required", c("route").isin("legacy_doc_unsupported", "needs_fallback"))


def pack_issue(name: Column, has_readme: Column, warned: Column) -> Column:
    """What is wrong with a pack: no README, or an old pack without a warning; else null."""
    return F.when(~has_readme, "missing README.md").when(F.lower(name).contains("v1") & ~warned, "v1 pack missing quality warning")


def resumed(items: DataFrame, ledger: DataFrame, outcome: Column) -> DataFrame:
    """(item, status, done_now): the ledger's successes as they are, and the outcome of all other items, failures tried again."""
    done = ledger.where("status = 'succeeded'").select("item").distinct()
    left = items.join(done, "item", "left_anti").select("item", outcome.alias("status"), F.lit(True).alias("done_now"))
    return left.union(items.join(done, "item", "left_semi").select("item", F.lit("succeeded"), F.lit(False)))
