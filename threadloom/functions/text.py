"""Text kernel: line normalisation, tokens, weights, chunks, hashes. All of it is built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that results depend on.
STOP_WORDS = """the and for that with this from have your into about there would could should what
when where which while will want need using used then than they them their does
did how why can you our are not but all was were has had its let lets
also just like more some such over under onto each very true false null text
code json file files data output message messages conversation conversations
procedure procedures issue issues problem problems check checks checking guide guides
outline overview example examples request requests step steps troubleshooting troubleshoot
any one might across below brief known eventually value values""".split()
SHORT_TOKENS = "ad ai ca cd ci db dc id ip ml os ps qa ui ux vm c# f#".split()
NOISE_TOKENS = "--- ---- ### #### ##### ``` ~~~ nbsp quot amp lt gt".split()
ROLE_WEIGHTS = {"user": 2.0, "assistant": 1.2, "tool": 0.9, "system": 0.0}
OTHER_ROLE, TITLE, CODE, OUTPUT = 0.8, 6.0, 0.35, 0.20
STRUCTURED, PHRASE = 1.15, 1.75
#: Weights are summed as whole numbers of this unit, so that the order of summing never shows.
UNIT = 100_000

SPACE = r"[\s\x85\p{Z}]"


def is_blank(c: Column) -> Column:
    return c.isNull() | c.rlike(rf"^{SPACE}*$")


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+$", "")


def or_default(c: Column, default: str) -> Column:
    """Blank becomes the default; else trimmed."""
    return F.when(is_blank(c), F.lit(default)).otherwise(trimmed(c))


def folded(c: Column) -> Column:
    """Upper case by single characters, for order and equality without case; the sharp s has no single capital and stays."""
    return F.translate(F.upper(F.translate(c, "\u00df", "\ue0df")), "\ue0df", "\u00df")


def units(c: Column) -> Column:
    """Length in UTF-16 code units: characters beyond the basic plane count twice."""
    return F.char_length(c) + F.regexp_count(c, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def first_units(c: Column, n: int) -> Column:
    """The first ``n`` code units; a pair that the cut would halve is left out."""
    short = F.octet_length(c) <= n
    ends = F.filter(F.sequence(F.lit(n // 2), F.lit(n)), lambda i: units(F.left(c, i)) <= n)
    return F.when(short | (F.char_length(c) == units(c)), F.left(c, F.lit(n))).otherwise(F.left(c, F.array_max(ends)))


def split_lines(c: Column) -> Column:
    return F.split(F.replace(c, F.lit("\r\n"), F.lit("\n")), "\n", -1)


def plain_line(raw: Column) -> Column:
    """A markdown line without fence, heading, quote, bullet, emphasis and number marks."""
    line = trimmed(raw)
    body = trimmed(F.regexp_replace(F.regexp_replace(F.regexp_replace(line, rf"^([#>]{SPACE}*)+", ""), rf"^[-*+] {SPACE}*", ""), r"\*\*|__|`", " "))
    numbered = F.regexp_replace(body, rf"^(?=[0-9.]*[0-9])[0-9.]+(?:[):]{SPACE}*|{SPACE}+)", "")
    return F.when(line.rlike("^(```|~~~)"), F.lit("")).otherwise(trimmed(numbered))


def is_structured(raw: Column, line: Column) -> Column:
    """Headings, bullets and numbers, or short lines."""
    return trimmed(raw).rlike(r"^(#|[-*+] |[0-9]+[.)])") | (units(line) <= 96)


def raw_tokens(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(r"[\p{L}\p{Nd}+#.\-_]+"), F.lit(0))


def named_token(raw: Column) -> Column:
    """The token in small letters, without marks at its ends."""
    low = F.lower(raw)
    return F.btrim(F.when(low == "c#", "csharp").when(low == "f#", "fsharp").when(low == ".net", "dotnet").otherwise(low), F.lit(".-_#+"))


def counts(t: Column, raw: Column) -> Column:
    """Whether a token, which was ``raw``, is one to count."""
    letters = F.regexp_replace(raw, r"[^\p{L}]", "")
    short = t.isin(SHORT_TOKENS) | letters.rlike(r"^\p{Lu}{2,4}$")
    return (
        (F.char_length(t) > 0)
        & ~t.startswith("http")
        & ~t.isin(NOISE_TOKENS)
        & t.rlike(r"[\p{L}\p{Nd}]")
        & ~t.rlike(r"^\p{Nd}+$")
        & (F.char_length(t) <= 48)
        & ((F.char_length(t) >= 3) | short)
        & ~t.isin(STOP_WORDS)
    )


def tokens(line: Column) -> Column:
    """Each token is named once, before it is looked at: an expression within a lambda is evaluated as often as it is written."""
    named = F.transform(raw_tokens(line), lambda raw: F.struct(named_token(raw).alias("t"), raw.alias("raw")))
    return F.transform(F.filter(named, lambda x: counts(x["t"], x["raw"])), lambda x: x["t"])


def phrases(toks: Column) -> Column:
    """Up to seven pairs of neighbours."""
    n = F.least(F.size(toks) - 1, F.lit(7))
    return F.when(n >= 1, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat_ws(" ", F.get(toks, i), F.get(toks, i + 1)))).otherwise(F.array().cast("array<string>"))


def word_count(term: Column) -> Column:
    return F.size(F.split(term, " "))


def role_units(role: Column) -> Column:
    out = F.lit(round(OTHER_ROLE * UNIT))
    for name, w in ROLE_WEIGHTS.items():
        out = F.when(F.lower(role) == name, F.lit(round(w * UNIT))).otherwise(out)
    return out


def term_tokens(term: Column) -> Column:
    """What tokenising a term again gives: short tokens that were let in for their capitals are lost."""
    return F.array_distinct(F.filter(F.split(term, " "), lambda t: (F.char_length(t) >= 3) | t.isin(SHORT_TOKENS)))


def diverse(candidates: Column, take: int) -> Column:
    """Greedy choice from a ranked array of structs with a ``term``: one whose tokens contain, or are contained in, those
    of a chosen one is passed over."""
    with_tokens = F.transform(candidates, lambda c: F.struct(c.alias("c"), term_tokens(c["term"]).alias("t")))

    def overlap(a: Column, b: Column) -> Column:
        both = F.size(F.array_intersect(a["t"], b["t"]))
        own = (F.size(a["t"]) > 0) & (F.size(b["t"]) > 0) & ((both == F.size(a["t"])) | (both == F.size(b["t"])))
        return (a["c"]["term"] == b["c"]["term"]) | own

    none = F.filter(with_tokens, lambda _: F.lit(False))
    chosen = F.aggregate(with_tokens, none, lambda acc, x: F.when((F.size(acc) >= take) | F.exists(acc, lambda y: overlap(y, x)), acc).otherwise(F.concat(acc, F.array(x))))
    return F.transform(chosen, lambda x: x["c"])


def fnv1a(s: Column) -> Column:
    """32-bit FNV-1a over the characters' code units."""
    points = F.transform(F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0)), lambda c: F.ascii(c).cast("long"))
    high, low = (lambda c: F.lit(0xD800) + F.shiftright(c - 0x10000, 10)), (lambda c: F.lit(0xDC00) + (c - 0x10000).bitwiseAND(F.lit(0x3FF)))
    code_units = F.flatten(F.transform(points, lambda c: F.when(c >= 0x10000, F.array(high(c), low(c))).otherwise(F.array(c))))
    return F.aggregate(code_units, F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * F.lit(16777619)).bitwiseAND(F.lit(4294967295)))


def chunks(c: Column, width: int = 1200) -> Column:
    """Pieces of fixed width in code units; none for blank text. A character that the width would halve goes to the next piece."""
    n = F.ceil(F.char_length(c) / width).cast("int")
    plain = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(c, i * width + 1, F.lit(width)))
    # A piece of ``width`` units: pairs of code units are matched as one character that counts two.
    pairs = F.transform(F.sequence(F.lit(0), F.ceil(units(c) / (width - 1)).cast("int")), lambda i: i)
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc, _):
        left = F.substring(c, acc["at"], F.lit(width))
        piece = first_units(left, width)
        return F.when(F.char_length(left) == 0, acc).otherwise(F.struct((acc["at"] + F.char_length(piece)).alias("at"), F.concat(acc["out"], F.array(piece)).alias("out")))

    walked = F.aggregate(pairs, start, step, lambda acc: acc["out"])
    return F.when(is_blank(c), F.array().cast("array<string>")).when(F.char_length(c) == units(c), plain).otherwise(walked)


def chunk_hash(kind: Column, text: Column) -> Column:
    return F.upper(F.sha2(F.concat(kind, F.lit("\n"), text), 256))


def unix_text(seconds: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ssZ`` of the milliseconds, cut off; ``(null)`` for none, and the number itself out of the years 1 to 9999."""
    inside = (seconds >= F.lit(-62135596800.0)) & (seconds < F.lit(253402300800.0))
    shown = F.date_format(F.timestamp_millis((seconds * 1000).cast("long")), "yyyy-MM-dd HH:mm:ss'Z'")
    return F.when(seconds.isNull(), F.lit("(null)")).when(inside, shown).otherwise(seconds.cast("string"))


def preview(c: Column) -> Column:
    """At most 80 code units on one line: line ends become blanks, the ends are trimmed, and blank text is empty."""
    flat = trimmed(F.translate(c, "\r\n", "  "))
    return F.when(is_blank(c), F.lit("")).when(units(flat) > 80, F.concat(first_units(flat, 80), F.lit("..."))).otherwise(flat)


def file_name(c: Column) -> Column:
    return first_units(F.regexp_replace(c, r'[\x00-\x1F"<>|:*?\\/]', "_"), 140)


def safe_name(title: Column, conversation_id: Column) -> Column:
    """The name of a conversation's files: its title, if any, and its id."""
    return file_name(F.when(is_blank(title), conversation_id).otherwise(F.concat(title, F.lit("__"), conversation_id)))


def stored_name(name: Column) -> Column:
    """A name that file systems take: one of over 200 bytes is cut to 48 characters and gets a part of its hash."""
    return F.when(F.octet_length(name) > 200, F.concat(F.left(name, F.lit(48)), F.lit("~"), F.left(F.sha2(name, 256), F.lit(16)))).otherwise(name)


def href(segment: Column) -> Column:
    """A path segment escaped for a link; a blank is %20."""
    return F.replace(F.url_encode(segment), F.lit("+"), F.lit("%20"))


def humanized(term: Column) -> Column:
    """Title case with ``_`` and ``-`` as blanks: each run of letters, digits and apostrophes that begins with a letter gets a
    capital and small letters, unless it has no small letter at all."""
    plain = trimmed(F.translate(term, "_-", "  "))
    pieces = F.regexp_extract_all(plain, F.lit(r"\p{L}[\p{L}\p{M}\p{N}']*|[^\p{L}]+"), F.lit(0))
    titled = F.transform(pieces, lambda x: F.when(x.rlike(r"^\p{L}") & x.rlike(r"\p{Ll}"), F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substring(x, 2, F.char_length(x))))).otherwise(x))
    return F.array_join(titled, "")


def humanized_terms(terms: Column) -> Column:
    return F.array_join(F.filter(F.transform(terms, humanized), lambda x: ~is_blank(x)), " / ")


def short_number(c: Column) -> Column:
    """At most three decimals, without trailing zeros: ``0.###``. Halves are rounded away from zero."""
    text = F.round(c.cast("decimal(38,12)"), 3).cast("string")
    whole = F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    return F.regexp_replace(whole, r"^-0$", "0")


def percent(c: Column) -> Column:
    """One decimal and a sign: ``12.5 %``. Halves are rounded away from zero."""
    return F.concat(F.format_number(F.round((c * 100).cast("decimal(38,12)"), 1), 1), F.lit(" %"))


def leaf(category: Column) -> Column:
    parts = F.filter(F.transform(F.split(category, "/"), trimmed), lambda p: p != "")
    return F.element_at(parts, -1)
