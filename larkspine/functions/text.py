"""String, map and hash expressions as Column builders; nothing here leaves the JVM.

Lengths count code points.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` and its lambdas use it."""
    return F.transform(F.array(value), then)[0]


def jtrim(c: Column) -> Column:
    """Without leading and trailing characters up to U+0020."""
    return F.regexp_replace(c, r"^[\x00-\x20]+|[\x00-\x20]+\z", "")  # $ would also match before a last U+0085, U+2028 or U+2029


def truncate(c: Column, n: int) -> Column:
    """The first n characters and ``...`` if there are more."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def tokens_basic(c: Column) -> Column:
    """Tokenizer A: ASCII words of two or more characters, lower case, repeats kept."""
    return F.filter(F.split(F.lower(F.regexp_replace(c, r"[^\w\s]", " ")), r"\s+"), lambda t: F.length(t) > 1)


_HAN = r"[\x{4E00}-\x{9FA5}]"


def tokens_mixed(c: Column) -> Column:
    """Tokenizer B: distinct lower-case ASCII words, and the 2- to 4-character windows with a Han character of all other parts."""

    none = F.array().cast("array<string>")

    def grams(part: Column) -> Column:
        clean = F.regexp_replace(part, r"[^\w\s\x{4E00}-\x{9FA5}]", " ")
        return F.when(part.rlike(_HAN), let(clean, windows)).otherwise(none)

    def windows(clean: Column) -> Column:
        n = F.length(clean)

        def sized(k: int) -> Column:
            return F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - (k - 1), F.lit(1))), lambda i: F.substring(clean, i, F.lit(k)))).otherwise(none)

        whole = F.filter(F.flatten(F.array(sized(2), sized(3), sized(4))), lambda g: g.rlike(_HAN) & ~g.rlike(r"^\s|\s$"))
        return F.transform(whole, F.lower)

    parts = F.split(c, r"\s+")
    each = F.transform(
        parts,
        lambda p: F.when(p.rlike("^[a-zA-Z]+$"), F.when(F.length(p) > 1, F.array(F.lower(p))).otherwise(none)).otherwise(grams(p)),
    )
    return F.array_distinct(F.filter(F.flatten(each), lambda t: F.length(t) >= 2))


def tokens_unicode(c: Column) -> Column:
    """An extension: words of letters and digits of any script, lower case, distinct."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) > 0))


def word_set(c: Column) -> Column:
    """Distinct lower-case parts between white space."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda t: t != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def extension(name: Column) -> Column:
    """Lower-case part after the last dot; ``unknown`` without one."""
    return F.when(name.contains("."), F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise("unknown")


def filename_metadata(name: Column) -> Column:
    """struct<ext, year, quarter> found in a file name; null where there is none."""
    first = lambda p: F.nullif(F.regexp_extract(name, p, 0), F.lit(""))
    return F.struct(extension(name).alias("ext"), first(r"20\d{2}").alias("year"), first(r"Q[1-4]").alias("quarter"))


def route(name: Column) -> Column:
    """The parser that a file name asks for: pdf, markdown, text, office or generic."""
    ext = extension(name)
    return (
        F.when(ext == "pdf", "pdf")
        .when(ext.isin("md", "markdown"), "markdown")
        .when(ext.isin("txt", "json", "xml", "csv"), "text")
        .when(ext.isin("doc", "docx", "xls", "xlsx", "ppt", "pptx"), "office")
        .otherwise("generic")
    )


#: Extensions that count as text where the type is unknown.
TEXT_EXTENSIONS = ("txt", "md", "markdown", "json", "xml", "csv", "yaml", "yml", "html", "htm", "log", "properties", "sql")
TEXT_TYPES = ("application/json", "application/xml", "application/javascript")


def is_text(mime: Column, name: Column) -> Column:
    """By the type if it is known, else by the extension."""
    known = mime.startswith("text/") | mime.isin(*TEXT_TYPES)
    return F.when(mime.isNotNull(), known).otherwise(extension(name).isin(*TEXT_EXTENSIONS))


def full_text(blocks: Column) -> Column:
    """Text and Markdown blocks (type, content), each followed by a blank line, trimmed."""
    some = F.filter(blocks, lambda b: b["type"].isin("TEXT", "MARKDOWN"))
    return jtrim(F.array_join(F.transform(some, lambda b: b["content"]), "\n\n"))


def image_blocks(blocks: Column) -> Column:
    return F.filter(blocks, lambda b: b["type"] == "IMAGE")


def drop_empty(m: Column) -> Column:
    return F.map_filter(m, lambda k, v: v.isNotNull() & (v != ""))


def merge_maps(*maps: Column) -> Column:
    """Entries of all maps; of equal keys the last map's."""
    return reduce(lambda old, new: F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new), maps)


def document_id(strategy: str, path: Column, content: Column) -> Column:
    """PATH: the path; CONTENT_HASH: MD5 of the content; UUID: random."""
    if strategy == "PATH":
        return F.coalesce(path, F.md5(content))
    if strategy == "CONTENT_HASH":
        return F.md5(content)
    if strategy == "UUID":
        return F.uuid()
    raise ValueError(strategy)


def percentage(c: Column) -> Column:
    return F.format_string("%.2f%%", c * 100)


def highlight(text: Column, terms: list[str], fragment: int = 100, most: int = 3) -> Column:
    """Up to ``most`` pieces of ``fragment`` characters that hold a term, with terms in em tags."""
    import re

    pattern = "(?i)(" + "|".join(re.escape(t) for t in terms) + ")"
    n = F.ceil(F.length(text) / fragment).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: F.substring(text, i * fragment + 1, F.lit(fragment)))
    hits = F.slice(F.filter(pieces, lambda p: p.rlike(pattern)), 1, most)
    return F.transform(hits, lambda p: F.regexp_replace(p, pattern, "<em>$1</em>"))


def matched_terms(marked: Column) -> Column:
    """What em tags hold, distinct, in order."""
    return F.array_distinct(F.regexp_extract_all(marked, F.lit("<em>(.*?)</em>"), F.lit(1)))


def metadata_json(m: Column) -> Column:
    return F.to_json(m)


def image_index_text(filename: Column, description: Column, width: Column, height: Column, fmt: Column) -> Column:
    """The text under which an image is indexed: a heading, then file, description and, if known, size and format lines."""
    line = lambda label, value: F.concat(F.lit(label), value, F.lit("\n"))
    size = F.when(width.isNotNull(), F.concat(line("尺寸: ", F.concat(width.cast("string"), F.lit("x"), height.cast("string"))), line("格式: ", fmt))).otherwise("")
    return F.concat(F.lit("【图像内容】\n"), line("文件名: ", filename), line("描述: ", description), size)
