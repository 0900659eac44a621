"""Scalar functions on text, URLs and hashes as Column expressions: they stay in code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Scenario patterns, the first that fits counts; question dimensions, all that fit count.
SCENARIOS = (
    ("troubleshoot", r"(报错|失败|错误|异常|为什么.*不|why.*fail|debug)"),
    ("update", r"(最近|最新|更新|版本|changelog|latest update)"),
    ("compare", r"( vs |对比|区别|差异|谁更|哪个好|compare)"),
    ("howto", r"(怎么|如何|使用方法|部署|安装|how to|install|setup)"),
    ("config", r"(配置|参数|选项|configure|setting)"),
    ("definition", r"(是什么|做什么|用途|用来|简介|介绍|概念|特性|what is)"),
)
DIMENSIONS = {
    "direct": ("是什么", "什么是", "定义", "概念", "介绍", "概述", "摘要", "内容", "what is", "definition"),
    "action": ("如何", "怎么", "怎样", "操作", "配置", "安装", "使用", "创建", "部署", "how to", "how do", "steps", "guide"),
    "comparison": ("区别", "对比", "比较", "差异", "不同", "vs", "versus", "difference", "compare", "和.*区别"),
    "fault": ("风险", "问题", "错误", "故障", "异常", "限制", "不适合", "注意", "坑", "踩坑", "risk", "error", "issue", "limitation", "caveat"),
    "alias": ("别名", "又叫", "又称", "同义词", "同一个", "一样吗", "是指", "aka", "alias", "same as"),
    "version": ("版本", "edition", "版", "最新", "旧版", "新版", "升级", "v[0-9]", "version", "release", "changelog"),
}


# Tags and kinds of links that carry no text of a page.
NOISE_TAGS = ("script", "style", "noscript", "iframe", "svg")
NOISE_LINKS = ("prefetch", "preload", "dns-prefetch", "preconnect", "modulepreload")


def normal_body(body: Column) -> Column:
    """Line ends as LF, without line feeds at either end."""
    lf = F.replace(F.replace(body, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.regexp_replace(lf, r"^\n+|\n+\z", "")


def body_sha256(body: Column) -> Column:
    """Content hash: SHA-256 of the normalised body, null for a null body."""
    return F.sha2(normal_body(body), 256)


def is_digest(value: Column) -> Column:
    """Whether a value is a SHA-256 in hex, in any case and with blanks around it."""
    return F.coalesce(F.lower(F.trim(value)).rlike("^[0-9a-f]{64}$"), F.lit(False))


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def doc_id(url: Column, date: Column) -> Column:
    """<slug>-<date>-<first eight of the URL's hash>."""
    return F.concat_ws("-", url_slug(url), date, F.substring(F.sha2(url, 256), 1, 8))


def url_host(url: Column) -> Column:
    """Lower-case host without user, port and leading www.; null where there is none."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)", 1)
    return F.when(host != "", host)


def url_key(url: Column) -> Column:
    """One key for the variants of a page: no scheme, www, query, fragment, index file or closing slash."""
    bare = F.regexp_replace(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://(www\.)?", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"[?#].*$", ""), r"(/index\.html?)?/*$", "")
    return F.when(bare != "", bare)


def url_slug(url: Column) -> Column:
    """Host and path as a slug of at most 100 characters; 'unknown' when nothing is left."""
    bare = F.regexp_replace(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"[?#].*$", ""), r"[^a-z0-9_\x{4e00}-\x{9fff}]+", "-")
    cut = F.regexp_replace(F.substring(F.regexp_replace(F.regexp_replace(bare, "-+", "-"), r"^[-_]+|[-_]+$", ""), 1, 100), r"[-_]+$", "")
    return F.when(F.coalesce(F.length(cut), F.lit(0)) == 0, "unknown").otherwise(cut)


def urls_in(text: Column) -> Column:
    """Distinct URLs in order of appearance, without closing punctuation."""
    found = F.regexp_extract_all(text, F.lit(r"(https?://[^\s<>\"\)\]]+)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?]+$", "")))


def url_kind(url: Column) -> Column:
    """Which direct-text route fits a URL: code host, paper, RFC, document file or web page."""
    u = F.lower(url)
    return (
        F.when(u.rlike(r"^https?://(www\.)?github\.com/[^/]+/[^/]+"), "github")
        .when(u.rlike(r"^https?://(www\.)?gitlab\.com/[^/]+/[^/]+"), "gitlab")
        .when(u.rlike(r"^https?://(www\.)?arxiv\.org/(abs|pdf|html)/"), "arxiv")
        .when(u.rlike(r"rfc-editor\.org|/rfc[-_]?\d+"), "rfc")
        .when(u.rlike(r"\.(pdf|docx?|pptx?|xlsx?)$"), "file")
        .when(u.rlike(r"^https?://"), "web")
    )


def github_parts(url: Column) -> Column:
    """struct(kind, owner, repo, branch, path) of a GitHub URL; null fields where it is none."""
    rx = r"^https?://(?:www\.)?github\.com/([^/?#]+)/([^/?#]+)(?:/(blob|tree|raw)/([^/?#]+)(?:/([^?#]*))?)?"
    part = lambda i: F.nullif(F.regexp_extract(url, rx, i), F.lit(""))
    return F.struct(F.when(part(1).isNotNull(), F.coalesce(part(3), F.lit("repo"))).alias("kind"), part(1).alias("owner"), F.regexp_replace(part(2), r"\.git$", "").alias("repo"), part(4).alias("branch"), part(5).alias("path"))


def arxiv_pdf(url: Column) -> Column:
    """PDF address of an arXiv URL, with its version; null for others."""
    number = F.regexp_extract(url, r"arxiv\.org/(?:abs|pdf|html)/(\d{4}\.\d{4,5}(?:v\d+)?|[a-z-]+(?:\.[A-Z]{2})?/\d{7}(?:v\d+)?)", 1)
    return F.when(number != "", F.concat(F.lit("https://arxiv.org/pdf/"), number))


def page_query(base: Column, page: Column, size: int, style: str) -> Column:
    """Search URL of a result page: 'start' counts from 0, 'first' from 1 and is left out on page 1."""
    if style == "start":
        return F.concat(base, F.lit("&start="), ((page - 1) * size).cast("string"))
    return F.when(page <= 1, base).otherwise(F.concat(base, F.lit("&first="), ((page - 1) * size + 1).cast("string")))


def first_heading(text: Column) -> Column:
    """Text of the first ATX heading, null without one."""
    return F.nullif(F.trim(F.regexp_extract(text, r"(?m)^[ \t]*#{1,6}[ \t]+(.*)$", 1)), F.lit(""))


def first_paragraph(text: Column, most: int = 500) -> Column:
    """First block between blank lines that is no heading, its lines joined by blanks."""
    blocks = F.transform(F.split(F.replace(text, F.lit("\r"), F.lit("")), r"\n[ \t]*\n"), lambda b: F.trim(F.regexp_replace(F.regexp_replace(b, r"(?m)^[ \t]*#{1,6}[ \t].*$", ""), r"\s+", " ")))
    return F.substring(F.get(F.filter(blocks, lambda b: b != ""), F.lit(0)), 1, most)


def truncate_utf8(text: Column, most: int) -> Column:
    """Longest prefix of at most `most` bytes that ends at a character."""
    raw = F.substring(F.encode(text, "UTF-8"), 1, most).cast("string")
    whole = F.when(F.is_valid_utf8(raw), raw).otherwise(F.regexp_replace(F.make_valid_utf8(raw), "\ufffd+$", ""))
    return F.when(F.octet_length(text) <= most, text).otherwise(whole)


def scenario(question: Column) -> Column:
    """The first scenario whose pattern the question matches, else 'general'."""
    q = F.lower(F.coalesce(question, F.lit("")))
    out = F
    for name, rx in SCENARIOS:
        out = out.when(q.rlike(rx), name)
    return out.otherwise("general")


def question_dimensions(question: Column) -> Column:
    """All dimensions that a question asks about, ['direct'] without any."""
    q = F.lower(F.coalesce(question, F.lit("")))
    found = F.array_compact(F.array(*[F.when(q.rlike("|".join(words)), F.lit(name)) for name, words in DIMENSIONS.items()]))
    return F.when(F.size(found) == 0, F.array(F.lit("direct"))).otherwise(found)


def missing_dimensions(questions: Column) -> Column:
    """The dimensions that none of a list of questions asks about: all of them for a null or empty list."""
    covered = F.flatten(F.transform(F.coalesce(questions, F.array().cast("array<string>")), question_dimensions))
    return F.array_except(F.array(*map(F.lit, DIMENSIONS)), covered)


def topic_of(doc: Column) -> Column:
    """A document id without its date and hash."""
    return F.regexp_replace(doc, r"-\d{4}-\d{2}-\d{2}(-[0-9a-f]{8})?$", "")


def clean_list(values: Column) -> Column:
    """Trimmed entries without blanks; an empty list for null."""
    return F.coalesce(F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != ""), F.array().cast("array<string>"))


def json_list(text: Column) -> Column:
    """Entries of a JSON list of strings; an empty list for null or broken JSON."""
    return clean_list(F.from_json(text, "array<string>"))


def tokens(text: Column) -> Column:
    """Lower-case words of two or more ASCII letters or digits, and single CJK characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]{2,}|[\x{4e00}-\x{9fff}])"), F.lit(1))


def strip_markup(html: Column) -> Column:
    """HTML without scripts, styles, frames, drawings, prefetch links and comments."""
    for tag in NOISE_TAGS:
        html = F.regexp_replace(html, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", "")
    html = F.regexp_replace(html, rf"(?is)<link\b[^>]*rel=[\"']?(?:{'|'.join(NOISE_LINKS)})[^>]*>", "")
    return F.regexp_replace(html, r"(?s)<!--.*?-->", "")


def json_block(text: Column) -> Column:
    """The outermost braces of a model's answer, with a code fence around them or not; null without any."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def frontmatter_of(fields: dict[str, Column]) -> Column:
    """Frontmatter block of the fields that are neither null nor blank, values as JSON strings where they need quotes."""
    lines = [
        F.when(F.length(F.trim(v)) > 0, F.concat(F.lit(f"{k}: "), F.when(v.rlike(r"^[\w./:@+-]+$"), v).otherwise(F.concat(F.lit('"'), F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"')))))
        for k, v in fields.items()
    ]
    return F.concat(F.lit("---\n"), F.array_join(F.array_compact(F.array(*lines)), "\n"), F.lit("\n---\n"))


def normal_text(text: Column) -> Column:
    """Without byte-order mark, line ends as LF."""
    return F.regexp_replace(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), r"^\x{feff}", "")


def file_slug(name: Column) -> Column:
    """A file name as a slug: lower case, all but Latin letters, digits and CJK as one dash; 'untitled' when nothing is left."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(name, r"\.[A-Za-z0-9]+$", "")), r"[^a-z0-9\x{4e00}-\x{9fff}]+", "-"), r"^-+|-+$", "")
    return F.when(F.coalesce(F.length(slug), F.lit(0)) == 0, "untitled").otherwise(slug)


def title_of(text: Column, lines: int = 50, most: int = 200) -> Column:
    """The first level-one heading among the first lines, else the first line that isn't blank; null for a blank text."""
    top = F.slice(F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n"), 1, lines)
    heads = F.transform(F.filter(top, lambda x: x.rlike(r"^#[ \t]+[^ \t]")), lambda x: F.regexp_replace(x, r"^#[ \t]+|[ \t]+$", ""))
    filled = F.filter(F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n"), lambda x: x.rlike(r"[^ \t\f]"))
    return F.substring(F.coalesce(F.get(heads, F.lit(0)), F.regexp_replace(F.get(filled, F.lit(0)), r"^[ \t\f]+|[ \t\f]+$", "")), 1, most)


def rfc_number(url: Column) -> Column:
    """The number of the RFC that a URL names; null where it names none."""
    return F.nullif(F.regexp_extract(url, r"(?i)rfc[-_]?(\d+)", 1), F.lit("")).cast("long")


def gitlab_raw(url: Column) -> Column:
    """Address of the raw text of a file on GitLab; null for other URLs."""
    rx = r"^(https?://[^/]*gitlab[^/]*/.+?)/-/blob/(.+)$"
    return F.when(url.rlike(rx), F.regexp_replace(url, rx, "$1/-/raw/$2"))


def meta_contents(html: Column, name: str) -> Column:
    """The contents of all <meta> tags of a name or property, in order of appearance."""
    tags = F.regexp_extract_all(html, F.lit(rf"(?is)(<meta\b[^>]*\b(?:name|property)=[\"']?{name}[\"'\s>][^>]*>)"), F.lit(1))
    return F.filter(F.transform(tags, lambda t: F.regexp_extract(t, r"(?is)\bcontent=[\"']([^\"']*)[\"']", 1)), lambda x: x != "")


def image_links(markdown: Column, folder: str) -> Column:
    """Markdown whose relative image links point into a folder; absolute ones stay."""
    return F.regexp_replace(markdown, r"!\[([^\]]*)\]\((?!https?://|/|data:)(?:\./)?([^)\s]+)\)", f"![$1]({folder}/$2)")


def strict_list(text: Column) -> Column:
    """Entries of a JSON list of strings; anything else but null is an error."""
    parsed = F.from_json(text, "array<string>")
    return F.when(text.isNull() | parsed.isNotNull(), parsed).otherwise(F.raise_error(F.concat(F.lit("not a JSON list: "), text)).cast("array<string>"))


def sparse_vector(terms: Column) -> Column:
    """map<string, double> of a list of structs (token, weight): one entry a token, its greatest weight; weights of 0 and null tokens are left out."""
    kept = F.filter(terms, lambda t: t["token"].isNotNull() & (F.coalesce(t["weight"], F.lit(0.0)) != 0))
    best = F.filter(kept, lambda t, i: ~F.exists(kept, lambda u: (u["token"] == t["token"]) & (u["weight"] > t["weight"])) & ~F.exists(F.slice(kept, 1, i), lambda u: (u["token"] == t["token"]) & (u["weight"] == t["weight"])))
    return F.map_from_entries(F.transform(best, lambda t: F.struct(t["token"].alias("key"), t["weight"].cast("double").alias("value"))))


def evidence_score(score: Column) -> Column:
    """A score within 0 and 100; 0 for none."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.coalesce(score.cast("double"), F.lit(0.0))))


def evidence_hash(declared: Column, markdown: Column) -> Column:
    """The declared hash of a tool's result, else that of its text; null for neither."""
    return F.coalesce(F.nullif(F.trim(declared), F.lit("")), F.when(F.length(F.trim(markdown)) > 0, F.sha2(markdown, 256)))


def needs_enrichment(summary: Column, keywords: Column, questions: Column) -> Column:
    """Whether a chunk still lacks its summary, keywords or questions."""
    empty = lambda c: F.coalesce(F.size(clean_list(c)), F.lit(0)) == 0
    return (F.coalesce(F.trim(summary), F.lit("")) == "") | empty(keywords) | empty(questions)


# Parts of a URL that say a source is official documentation.
OFFICIAL = ("/docs/", "docs.", ".readthedocs.", "arxiv.org/abs", "rfc-editor.org", "tools.ietf.org/rfc")


def inferred_type(url: Column, tool: Column | None = None) -> Column:
    """Source type that a URL suggests: official-doc or community; raw texts from a code host count as official. community for a null or blank URL."""
    u = F.lower(F.coalesce(url, F.lit("")))
    official = F.lit(False)
    for part in OFFICIAL:
        official = official | F.contains(u, F.lit(part))
    if tool is not None:
        official = official | (tool.eqNullSafe(F.lit("raw_text")) & F.contains(u, F.lit("github.com")))
    return F.when(official, "official-doc").otherwise("community")
