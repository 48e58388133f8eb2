"""HTML as Catalyst expressions: markup text -> tokens -> element tree, inside one row.

Every function here maps columns to columns, so a page never leaves its row: parsing a corpus
is a map-only job without shuffle, whatever the number of captures per URL or host.
"""

from __future__ import annotations

from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitegauge.constants import BOILERPLATE_TAGS, VOID_TAGS
from sitegauge.functions.cache import column_cache
from sitegauge.functions.nesting import CLOSE, LEAF, nesting

# Comments, whole script/style elements, tags (quotes respected after "="), declarations, text.
# Quantifiers are possessive where a repeated group could otherwise recurse in java.util.regex.
TOKEN_PATTERN = (
    r"(?is)<!--.*?-->"
    r"|<script\b[^>]*+>.*?</script\s*+>"
    r"|<style\b[^>]*+>.*?</style\s*+>"
    r"""|</?[a-z](?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+>"""
    r"|<[!?][^>]*+>"
    r"|(?:[^<]++|<(?![a-z/!?]))++"
)
ATTR_PATTERN = r"""([a-zA-Z_:@][-a-zA-Z0-9_:.]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?"""

TOKENS_TYPE = "array<struct<pos:int,kind:string,tag:string,raw:string>>"

# Character references: numeric, named, and what stands between them.
REFERENCE_PATTERN = r"&#(?:0*+[0-9]{1,7}|[xX]0*+[0-9a-fA-F]{1,6}|0++|[xX]0++);?|&[a-zA-Z][a-zA-Z0-9]{1,31};?|[^&]++|&"
# Names of the HTML standard that are also read without a semicolon, longest first.
BARE_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
# Numbers 128 to 159 mean the characters of Windows-1252, as browsers read them.
WINDOWS = "".join(bytes([c]).decode("cp1252", "ignore") or chr(c) for c in range(128, 160))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for ``body``; lambda bodies have no common-subexpression elimination.

    The fold over nothing only applies its final step, and unlike ``transform`` does not copy
    the result.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda bound, _: bound, body)


# --- fixed values: Unicode white space ---
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    """Trim every kind of white space, not only the space character."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def collapse(text: Column) -> Column:
    """White-space runs to one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def is_text(value: Column) -> Column:
    """Null and the empty string are both "nothing"."""
    return F.coalesce(value != "", F.lit(False))


@column_cache
def _references() -> Column:
    """Map of all names of the HTML standard, with and without semicolon; folded to one literal."""
    names = list(html5)
    return F.map_from_arrays(F.split(F.lit("\n".join(names)), "\n"), F.split(F.lit("\x1f".join(html5[n] for n in names)), "\x1f"))


def unescape(text: Column, bare: bool = True) -> Column:
    """Character references to characters in one pass; texts without ``&`` pass untouched.

    ``bare`` also reads the old names without semicolon; attribute values, where ``&copy=1`` is a
    query parameter, go without. What is no reference stays as it is.
    """
    def numeric(piece: Column) -> Column:
        digits = F.regexp_replace(F.regexp_extract(piece, r"^&#([0-9]+|[xX][0-9a-fA-F]+)", 1), "^([xX]?)0+(?=[0-9a-fA-F])", "$1")
        code = F.when(F.lower(digits).startswith("x"), F.conv(F.substring(digits, 2, 6), 16, 10)).otherwise(digits).cast("int")
        valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        return F.when(code.between(128, 159), F.lit(WINDOWS).substr(code - 127, F.lit(1))).when(valid, char).otherwise(piece)

    def named(piece: Column) -> Column:
        whole = F.try_element_at(_references(), piece.substr(F.lit(2), F.length(piece)))
        known = F.when(piece.endswith(";") | F.lit(bare), whole)
        if not bare:
            return F.coalesce(known, piece)
        prefix = F.regexp_extract(piece, f"^&({'|'.join(BARE_NAMES)})", 1)
        longest = F.concat(F.try_element_at(_references(), prefix), piece.substr(F.length(prefix) + 2, F.length(piece)))
        return F.coalesce(known, longest, piece)

    def read(piece: Column) -> Column:
        return F.when(~piece.startswith("&") | (piece == "&"), piece).when(piece.startswith("&#"), numeric(piece)).otherwise(named(piece))

    pieces = F.regexp_extract_all(text, F.lit(REFERENCE_PATTERN), F.lit(0))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(pieces, read), "")).otherwise(text)


def tokens(html: Column) -> Column:
    """Array of ``(pos, kind, tag, raw)``; kind is open, close, text, comment or decl.

    ``raw`` is the markup as it stands, but for text, where references are read once for all uses.
    """

    def read(pos: Column, kind: Column, tag: Column, raw: Column) -> Column:
        return F.struct(pos.cast("int").alias("pos"), kind.alias("kind"), tag.alias("tag"), raw.alias("raw"))

    def markup(raw: Column, pos: Column) -> Callable[[Column], Column]:
        def named(tag: Column) -> Column:
            kind = (
                F.when(tag != "", F.when(raw.startswith("</"), "close").otherwise("open"))
                .when(raw.startswith("<!--"), "comment")
                .when(raw.startswith("<!") | raw.startswith("<?"), "decl")
                .otherwise("text")
            )
            return read(pos, kind, F.nullif(tag, F.lit("")), raw)

        return named

    # Texts are told by their first character; of the others the name is read once, for kind and tag.
    def token(raw: Column, pos: Column) -> Column:
        tag = F.lower(F.regexp_extract(raw, r"^</?([a-zA-Z][^\s/>]*)", 1))
        text = read(pos, F.lit("text"), F.lit(None).cast("string"), unescape(raw))
        return F.when(raw.startswith("<"), let(tag, markup(raw, pos))).otherwise(text)

    return F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(TOKEN_PATTERN), F.lit(0)), token)


def runs(items: Column, key: str) -> Column:
    """``(key, at, i, n)`` of every distinct key of an array of structs: first index, last index, number.

    In order of first occurrence. The items are sorted by key and cut where it changes, so the
    work is that of sorting, however many keys there are.
    """
    tagged = F.array_sort(F.transform(items, lambda x, i: F.struct(x[key].alias("key"), i.alias("i"))))

    def cut(rows: Column) -> Column:
        marked = F.transform(rows, lambda x, k: F.struct(
            x["key"].alias("key"), x["i"].alias("i"), k.alias("k"),
            ((k == 0) | ~x["key"].eqNullSafe(F.get(rows, k - 1)["key"])).alias("new")))
        return let(F.filter(marked, lambda x: x["new"]), lambda firsts: F.transform(firsts, lambda x, j: let(
            F.coalesce(F.get(firsts, j + 1)["k"], F.size(rows)),
            lambda stop: F.struct(x["i"].alias("at"), x["key"].alias("key"), F.get(rows, stop - 1)["i"].alias("last"), (stop - x["k"]).alias("n")))))

    return F.array_sort(let(tagged, cut))


def last_values(entries: Column) -> Column:
    """Map of an array of ``(key, value)``; the last value of a key wins, keys stand in order of first occurrence."""
    return let(entries, lambda e: F.map_from_entries(F.transform(
        runs(e, "key"), lambda r: F.struct(r["key"], F.get(e, r["last"])["value"]))))


def attributes(raw: Column) -> Column:
    """Attribute map of an opening tag: names lowered, quotes off, references decoded, last one wins.

    An attribute without value maps to the empty string.
    """
    body = F.regexp_extract(
        raw, r"""(?is)^<[a-z][^\s/>]*((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>""", 1
    )
    pattern = F.lit(ATTR_PATTERN)

    def value(token: Column) -> Column:
        quoted = token.startswith('"') | token.startswith("'")
        plain = F.when(quoted, token.substr(F.lit(2), F.length(token) - 2)).otherwise(token)
        return F.when(F.contains(token, F.lit("&")), unescape(plain, bare=False)).otherwise(plain)

    def build(pair: Column) -> Column:
        unique = F.size(F.array_distinct(pair["names"])) == F.size(pair["names"])
        return F.when(unique, F.map_from_arrays(pair["names"], pair["values"])).otherwise(
            last_values(F.arrays_zip(pair["names"].alias("key"), pair["values"].alias("value"))))

    return F.when(
        body.rlike(r"[a-zA-Z_:@]"),
        let(
            F.struct(
                F.transform(F.regexp_extract_all(body, pattern, F.lit(1)), F.lower).alias("names"),
                F.transform(F.regexp_extract_all(body, pattern, F.lit(2)), value).alias("values"),
            ),
            build,
        ),
    ).otherwise(F.create_map().cast("map<string,string>"))


def _is_leaf(token: Column) -> Column:
    """Void, self-closed and whole script/style tokens have no children."""
    whole = token["tag"].isin("script", "style") & token["raw"].rlike(r"(?is)</(?:script|style)\s*>$")
    return token["tag"].isin(*VOID_TAGS) | token["raw"].endswith("/>") | whole


def tag_marks(toks: Column) -> tuple[Column, Column, Column]:
    """What the stack machine reads: tags as one string, their positions, the end of the page."""
    marks = F.filter(toks, lambda t: t["kind"].isin("open", "close"))
    spelt = F.transform(marks, lambda t: F.when(t["kind"] == "close", F.concat(F.lit(CLOSE), t["tag"])).when(
        _is_leaf(t), F.concat(t["tag"], F.lit(LEAF))).otherwise(t["tag"]))
    return F.array_join(spelt, " "), F.transform(marks, lambda t: t["pos"]), F.size(toks)


def nested_ends(toks: Column) -> Column:
    """End of every opening tag by order, then its depth in boilerplate, then its parent, in one array."""
    return nesting(*tag_marks(toks))


def nested(opened: Column, ends: Column) -> Column:
    """Elements of all tags, read without ends, with the ends of :func:`nested_ends`."""
    third = F.floor(F.size(ends) / 3).cast("int")
    return F.transform(opened, lambda e, i: F.struct(
        e["pos"].alias("pos"), e["tag"].alias("tag"), e["attrs"].alias("attrs"), F.get(ends, i).alias("close_pos"), e["raw"].alias("raw"),
        F.get(ends, i + third).alias("depth"), F.get(ends, i + third * 2).alias("parent")))


def elements(toks: Column, ends: Column | None, tags: tuple[str, ...] | None = None) -> Column:
    """Opening tags in document order as ``(pos, tag, attrs, close_pos, raw, depth, parent)``.

    ``ends`` is the result of :func:`nested_ends`; without it, for uses that read no content, every
    element ends where it starts. ``tags`` keeps the listed names only, so that attribute parsing
    is paid for just those.
    """
    opened = F.filter(toks, lambda t: t["kind"] == "open")
    placed = F.transform(opened, lambda t, i: F.struct(
        t["pos"].alias("pos"), t["tag"].alias("tag"), t["raw"].alias("raw"),
        (t["pos"] if ends is None else F.get(ends, i)).alias("close_pos"),
        (F.lit(0) if ends is None else F.get(ends, i + F.floor(F.size(ends) / 3).cast("int"))).alias("depth"),
        (F.lit(-1) if ends is None else F.get(ends, i + F.floor(F.size(ends) / 3).cast("int") * 2)).alias("parent"),
    ))
    if tags is not None:
        placed = F.filter(placed, lambda e: e["tag"].isin(*tags))
    return F.transform(
        placed,
        lambda e: F.struct(
            e["pos"].alias("pos"), e["tag"].alias("tag"), attributes(e["raw"]).alias("attrs"),
            e["close_pos"].alias("close_pos"), e["raw"].alias("raw"), e["depth"].alias("depth"), e["parent"].alias("parent"),
        ),
    )


def strings_between(toks: Column, start: Column, end: Column) -> Column:
    """Stripped, non-blank text nodes strictly between two token positions."""
    inner = F.slice(toks, start + 2, F.greatest(end - start - 1, F.lit(0)))
    texts = F.transform(F.filter(inner, lambda t: t["kind"] == "text"), lambda t: strip(t["raw"]))
    return F.filter(texts, lambda s: s != "")


def element_text(toks: Column, element: Column, separator: str) -> Column:
    return F.array_join(strings_between(toks, element["pos"], element["close_pos"]), separator)


def leaf_text(raw: Column) -> Column:
    """Content of a whole script or style token."""
    return F.regexp_extract(raw, r"(?is)^<(?:script|style)\b[^>]*+>(.*)</(?:script|style)\s*>$", 1)


def visible_chunks(toks: Column, els: Column) -> Column:
    """Visible text nodes of the body (whole page without one) in document order.

    Comments count as text nodes, boilerplate elements with all their content do not; without a
    body element the declaration text counts too.
    """
    body = F.get(F.filter(els, lambda e: e["tag"] == "body"), F.lit(0))
    first = F.coalesce(body["pos"], F.lit(-1))
    last = F.coalesce(body["close_pos"], F.size(toks))
    hidden = F.filter(els, lambda e: e["tag"].isin(*BOILERPLATE_TAGS) & (e["close_pos"] > e["pos"]))
    # Outermost boilerplate intervals only: the others have a depth.
    spans = F.filter(hidden, lambda e: e["depth"] == 0)

    def gap_chunks(bounds: Column) -> Column:
        starts = F.concat(F.array(bounds["first"]), F.transform(bounds["spans"], lambda s: s["close_pos"]))
        ends = F.concat(F.transform(bounds["spans"], lambda s: s["pos"]), F.array(bounds["last"]))
        gaps = F.zip_with(starts, ends, lambda a, b: F.struct(F.greatest(a, bounds["first"]).alias("a"), F.least(b, bounds["last"]).alias("b")))
        pieces = F.transform(gaps, lambda g: F.slice(toks, g["a"] + 2, F.greatest(g["b"] - g["a"] - 1, F.lit(0))))
        shown = F.filter(
            F.flatten(pieces),
            lambda t: t["kind"].isin("text", "comment") | ((t["kind"] == "decl") & (bounds["first"] < 0)),
        )
        texts = F.transform(
            shown,
            lambda t: strip(
                F.when(t["kind"] == "text", t["raw"])
                .when(t["kind"] == "comment", F.regexp_replace(t["raw"], r"(?s)^<!--|-->$", ""))
                .otherwise(F.regexp_replace(t["raw"], r"(?s)^<[!?]|>$", ""))
            ),
        )
        return F.filter(texts, lambda s: s != "")

    return let(F.struct(first.alias("first"), last.alias("last"), spans.alias("spans")), gap_chunks)
