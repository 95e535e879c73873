"""Sentence boundaries of LaTeX documents in many scripts, in SQL expressions only.

Every step but the last keeps the text's length in code points, so a place in the masked text
is the same place in the text:

1. The body is tiled into plain runs and markup; markup is filled with placeholders of the
   private-use area: ``NOTHING`` (comments, labels), ``WORD`` (formulas, citations, commands)
   and ``BREAK`` (headings, floats, list items); all but the first character of the first and last
   kind is ``REST``, at which no later step need stop. Of a displayed formula its closing mark stays.
2. Marks within a quotation whose sentence goes on, and those of decimals, abbreviations,
   initials, addresses and omissions, are masked.
3. ``END`` is put in after the last character of each sentence: one that closes with a mark
   of its script, one that a paragraph, list item or line before a list cuts off, or, in
   Thai, one before a blank.

The lengths of the parts between ``END`` then give the places, and the original text between them the sentences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD, REST, NOTHING, BREAK, MASKED, END = "\ue000", "\ue001", "\ue002", "\ue003", "\ue004", "\ue005"

# Marks, quotation marks and brackets of scripts beyond ASCII are brought to places side by side in the private-use area, and
# blanks to the ASCII blank: a class of ASCII and one range is a few comparisons, one of scattered characters a long search.
#: Sentence marks that need no blank after them.
FULL_MARKS = "。！？।॥؟۔｡"
OPENING, BOTH, CLOSING = "„«「『", "“", "”»」’』】》）］｝"
BLANKS = "\xa0\u2002\u2003\u2009\u200a\u200b\u2028\u2029\u202f\u3000\ufeff"
PLACES = {c: chr(0xE010 + i) for i, c in enumerate(FULL_MARKS)} | {c: chr(0xE020 + i) for i, c in enumerate(OPENING + BOTH + CLOSING)}
#: What the text holds of the area itself is put out of the way.
_FROM = "".join(PLACES) + BLANKS + "".join(map(chr, range(0xE000, 0xE050)))
_TO = "".join(PLACES.values()) + " " * len(BLANKS) + "x" * 80
_FULL = f"{PLACES['。']}-{PLACES['｡']}"
_MARK = f".?!{_FULL}"
_OPEN = f"`{PLACES['„']}-{PLACES['“']}"
_CLOSE = f"'\")\\]}}{PLACES['“']}-{PLACES['｝']}"

CASED = r"a-zA-Z\xc0-\u052f\u1e00-\u1fff"
# scripts by their blocks: a block is a comparison, a script property a search
CJK = r"\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\x{20000}-\x{3ffff}"
THAI = r"\u0e00-\u0e7f"
DEVANAGARI = r"\u0900-\u097f"

DISPLAYS = "equation|align|gather|multline|eqnarray|displaymath|flalign"
FLOATS = "figure|table|verbatim|lstlisting|thebibliography|tikzpicture|tabular"
HEADINGS = r"(?:sub)*section|(?:sub)?paragraph|chapter|part|title|author|date"
SILENT = "label|input|include|bibliography|bibliographystyle|includegraphics|vspace|hspace|usepackage|pagestyle"

#: Abbreviations that never close a sentence.
ALWAYS = (
    "Figs?|figs?|Eqs?|eqs?|éqs?|Secs?|secs?|Defs?|Thms?|Lem|Prop|Cor|App|Tabs?|tab|Refs?|Chap|chap|Ch|Vol|Ed|Eds|"
    "Dr|Drs|Prof|Mr|Mrs|Ms|Mme|Mlle|St|Sr|Sra|cf|Cf|vs|resp|approx|al|rev|viz|"
    "bzw|vgl|Vgl|Abb|Tab|ca|Kap|Gl|Abs|sog|ej|pág|págs|núm|Núm|EE|à-d|"
    "рис|табл|См|см|ср|Ср|гл|стр|проф|Рис|Табл|напр"
)
#: Abbreviations of a number that follows.
NUMBERED = "No|Nos|no|Nr|nr|Art|Bd|pp|S|n|№"
#: Abbreviations that may close a sentence: no end where it visibly goes on.
SOMETIMES = "etc|usw|др|пр|тыс|млн|ед|гг|UU|Inc|Ltd|Jr"

_G = r"[\s~]{0,3}"
_NOT_IN_WORD = rf"(?<![{CASED}\p{{N}}])"


def _braced(depth: int = 3) -> str:
    inner = r"[^{}]*+"
    for _ in range(depth):
        inner = rf"[^{{}}]*+(?:\{{{inner}\}}[^{{}}]*+)*+"
    return rf"\{{{inner}\}}"


def _tiles() -> str:
    """Plain runs and pieces of markup; together they are the whole text."""
    braced = _braced()
    return "|".join(
        (
            r"[^\\%$]++",
            r"%[^\r\n]*+",
            r"\$\$[\s\S]*?(?:\$\$|\z)",
            r"\$[^$]*+\$",
            r"\\end\{document\}[\s\S]*+",
            r"\\iffalse(?![a-zA-Z])[\s\S]*?(?:\\fi(?![a-zA-Z])|\z)",
            rf"\\begin\{{({FLOATS})\*?\}}[\s\S]*?(?:\\end\{{\1\*?\}}|\z)",
            rf"\\begin\{{({DISPLAYS})\*?\}}[\s\S]*?(?:\\end\{{\2\*?\}}|\z)",
            r"\\\[[\s\S]*?(?:\\\]|\z)",
            r"\\\([\s\S]*?(?:\\\)|\z)",
            rf"\\(?:{HEADINGS})(?![a-zA-Z])\*?(?:\[[^\]]*\])?{braced}",
            r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?",
            r"\\item(?![a-zA-Z])(?:\[[^\]]*\])?",
            rf"\\(?:{SILENT})(?![a-zA-Z])\*?(?:\[[^\]]*\])?\{{[^{{}}]*+\}}",
            rf"\\(?:cite[a-z]*|ref|eqref|pageref|autoref|url|footnote|footnotetext|mathrm|texttt)(?![a-zA-Z])\*?(?:\[[^\]]*\])*{braced}",
            r"\\(?:[a-zA-Z]++\*?|[\s\S])",
            r"[\s\S]",
        )
    )


TILES = _tiles()
_DISPLAY = rf"^\\begin\{{(?:{DISPLAYS})\*?\}}"
_DISPLAY_TAIL = rf"[.?!{FULL_MARKS}][\s]*(?:\$\$|\\\]|\\end\{{[a-z]+\*?\}})$"
_BREAKS = rf"^\\(?:(?:{HEADINGS}|item)(?![a-zA-Z])|begin\{{|end\{{(?!document\}}))"
_SILENT = rf"^\\(?:(?:{SILENT}|iffalse|maketitle|tableofcontents|centering|newpage|clearpage|noindent|bigskip|medskip|smallskip)(?![a-zA-Z])|end\{{document\}})"

#: The first two letters of the commands that _DISPLAY, _BREAKS and _SILENT know; all others are words.
_STARTS = ("be", "en", "it", "se", "su", "pa", "ch", "ti", "au", "da", "la", "in", "bi", "vs", "hs", "us", "if", "ma", "ta", "ce", "ne", "cl", "no", "me", "sm")

#: What shows that a sentence goes on after a quotation: a small letter, a comma, or a script without capitals.
_GOES_ON = rf"(?=[\s{NOTHING}{REST}]*[\p{{Ll}},;:，、；]|[{CJK}]|\s*[{DEVANAGARI}])"


def _quotes() -> str:
    """Quotations whose sentence goes on, and all else."""
    pairs = [("„", "“"), ("“", "”"), ("«", "»"), ("「", "」"), ("『", "』")]
    inside = "|".join(
        rf"{PLACES[a]}[^{PLACES[a]}{PLACES[b]}{BREAK}]*+{PLACES[b]}{_GOES_ON}" for a, b in pairs
    )
    return rf"[^{_OPEN}]++|``(?:[^`'{BREAK}]++|'(?!'))*+''{_GOES_ON}|{inside}|[\s\S]"


_QUOTES = _quotes()

_LETTERS = f"[^\\x00-\\x40\\x5b-\\x60\\x7b-\\x7f{WORD}-\ue0ff]"


def _before_dot(words: str) -> str:
    """One of the words, whole, before a dot. Words of one length share a lookbehind, which is tried at one place only."""
    plain = [w for word in words.split("|") for w in ((word[:-2], word[:-1]) if word.endswith("?") else (word,))]
    lengths = sorted({len(w) for w in plain})
    return "|".join(rf"(?<={_NOT_IN_WORD}(?:{'|'.join(w for w in plain if len(w) == n)})\.)" for n in lengths)


#: Marks that end nothing. The dot is looked for once; what stands right before it decides which rules are tried, and of
#: those with a condition on what follows that comes first.
_IDLE = (
    rf"\.(?:(?=[-.])|(?<=\.\.)|"  # omission
    rf"(?<=\p{{N}}\.)(?:(?=\p{{N}})|"  # 3.14
    rf"(?<=(?:[AI]m|[Vv]om|[Zz]um|[Bb]eim|[Dd]er|[Dd]ie|[Dd]as|[Dd]es|[Dd]em)\s{{1,3}}\p{{N}}{{1,2}}\.))|"  # Am 3. Mai
    # no abbreviation is longer than six letters
    rf"(?<={_LETTERS}\.)(?<![a-z]{{7}}\.)(?:(?=\p{{N}})|"  # A.5
    rf"(?<={_NOT_IN_WORD}\p{{Ll}}\.)|(?<={_NOT_IN_WORD}[ei]\.[eg]\.)|{_before_dot(ALWAYS)}|"
    rf"(?={_G}[\p{{N}}\p{{So}}<\[])(?:{_before_dot(NUMBERED)})|"
    rf"(?=[\s~{NOTHING}{REST}]*[\p{{Ll}}\p{{N}},;:{WORD}])(?:{_before_dot(SOMETIMES)})|"
    rf"(?<=\p{{Lu}}\.)(?:(?=[{CASED}])(?<={_NOT_IN_WORD}[{CASED}]\.)|(?<=B\.)(?<=z\.{_G}B\.)|"  # U.S, z. B.
    rf"(?={_G}[\p{{Lu}}\p{{So}}<\[])(?<={_NOT_IN_WORD}\p{{Lu}}\.)(?<!App\.[\s~]{{1,3}}\p{{Lu}}\.))|"  # initials
    r"(?<=[^\x00-\x7f]\.)(?<=(?:^|[\s(])(?:د|أ|डॉ|श्री|प्रो)\.)))"
)

_SHUT = f"[{_MARK}{_CLOSE}]"
_TAIL = rf"{_SHUT}*+(?:\s{PLACES['»']}{_SHUT}*+)?+"
_AFTER = rf"[\s{NOTHING}{BREAK}]"
_UNSEEN = rf"[\s{REST}-{BREAK}]"
_SEEN = rf"[^\s{REST}-{BREAK}]"
#: The end of a sentence: as group 2 the mark that makes it and what closes with it, or as group 1 the blank or markup after its last character.
_LAST = (
    # where an end can be at all: one class rules out most characters
    rf"(?=[ \t\n\x0b\f\r.?!{NOTHING}-{PLACES['｡']}])(?:"
    # blanks after the last visible character of a paragraph or item
    rf"([\s{NOTHING}](?![!-~])(?<={_SEEN}[\s{NOTHING}])(?:(?<=\n)(?=[ \t\r]*\n)|(?=[\s{NOTHING}{REST}]*(?:{BREAK}|\n[ \t\r]*\n))|"
    # Thai before a blank
    rf"(?<=[ \t])(?:(?=[ \t]*[{THAI}])(?<=[{THAI}{WORD}\p{{N}}][ \t])|(?<=[{THAI}][ \t])(?=[ \t]*[{WORD}\p{{N}}])))|"
    # markup after it
    rf"{BREAK}(?<={_SEEN}{BREAK}))|"
    # a mark that needs no blank after it
    rf"([{_FULL}]{_TAIL}|[.?!](?:(?<=[{CJK}][.?!]){_TAIL}|"
    # a mark before a blank, with no small letter after it
    rf"{_TAIL}(?={_AFTER})(?![\s{NOTHING}{REST}]*\p{{Ll}}))))"
)


def _fill(t: Column, with_: str) -> Column:
    if with_ == WORD:
        return F.repeat(F.lit(WORD), F.length(t))
    return F.concat(F.lit(with_), F.repeat(F.lit(REST), F.length(t) - 1))


def _masked_tile(t: Column) -> Column:
    tail = F.regexp_extract(t, _DISPLAY_TAIL, 0)
    display = F.when(tail == "", _fill(t, WORD)).otherwise(
        F.concat(
            F.repeat(F.lit(WORD), F.length(t) - F.length(tail)),
            F.translate(F.substring(tail, 1, 1), _FROM, _TO),
            F.repeat(F.lit(NOTHING), F.length(tail) - 1),
        )
    )
    first, second = F.ascii(t), F.substring(t, 2, 2)
    plain = F.when(F.octet_length(t) == F.length(t), t).otherwise(F.translate(t, _FROM, _TO))
    return (
        F.when(~first.isin(36, 37, 92), plain)
        .when(first == 37, _fill(t, NOTHING))
        .when(first == 36, F.when(F.startswith(t, F.lit("$$")), display).otherwise(_fill(t, WORD)))
        .when(F.startswith(t, F.lit("\\[")), display)
        .when(~second.isin(*_STARTS), _fill(t, WORD))
        .when((second == "be") & t.rlike(_DISPLAY), display)
        .when(t.rlike(_BREAKS), _fill(t, BREAK))
        .when(t.rlike(_SILENT), _fill(t, NOTHING))
        .otherwise(_fill(t, WORD))
    )


def _tiled(c: Column, tiles: str, each) -> Column:
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(tiles), F.lit(0)), each), "")


#: The text up to the first ``\\begin{document}`` that no comment holds.
_PREAMBLE = (
    r"^(?:[^%\\]++|%[^\r\n]*+|\\iffalse(?![a-zA-Z])[\s\S]*?(?:\\fi(?![a-zA-Z])|\z)|\\(?!begin\{document\})[\s\S]?)*+"
    r"\\begin\{document\}"
)


def body(text: Column) -> Column:
    """The text after ``\\begin{document}``, or all of it; one within a comment does not count."""
    preamble = F.when(F.contains(text, F.lit(r"\begin{document}")), F.length(F.regexp_extract(text, _PREAMBLE, 0))).otherwise(0)
    return F.substr(text, preamble + 1)


def ends_marked(body_: Column) -> Column:
    """``body_`` with markup and idle marks masked, and ``END`` put in after the last character of each sentence.

    Where a mark ends a paragraph too, there are two of them.
    """
    # what no running text follows (the bibliography, the end) need not be looked at
    masked = F.concat(F.rtrim(_tiled(body_, TILES, _masked_tile), F.lit(NOTHING + REST + BREAK + " \t\r\n")), F.lit(BREAK))
    idle_quotes = _tiled(
        masked, _QUOTES, lambda t: F.when(t.rlike(f"^[{_OPEN}]"), F.regexp_replace(t, f"[{_MARK}]", MASKED)).otherwise(t)
    )
    return F.regexp_replace(F.regexp_replace(idle_quotes, _IDLE, MASKED), _LAST, "$2" + END + "$1")


def _marked(documents: DataFrame) -> DataFrame:
    """doc_id, text, ``_offset`` of the body and ``_parts``: the masked body split at the sentences' ends."""
    return (
        documents.select("doc_id", "text")
        .where("text IS NOT NULL")
        .withColumn("_body", body(F.col("text")))
        .withColumn("_offset", F.length("text") - F.length("_body"))
        .withColumn("_marked", ends_marked(F.col("_body")))
        .select("doc_id", "text", "_offset", F.split("_marked", END).alias("_parts"))
    )


#: Parts whose places are added up together: an array grown by one is copied, so a long text's parts are taken in stretches.
STRETCH = 512


def _running(items: Column, start: Column, size, add, kind: str) -> Column:
    """``add(at, item)`` of every item as an array of ``kind``, where ``at`` is ``start`` and the sizes of the items before."""
    return F.aggregate(
        items,
        F.struct(start.cast("long").alias("at"), F.array().cast(f"array<{kind}>").alias("out")),
        lambda acc, x: F.struct((acc["at"] + size(x)).alias("at"), F.array_append(acc["out"], add(acc["at"], x)).alias("out")),
        lambda acc: acc["out"],
    )


def _places(each, kind: str) -> Column:
    """``each(start, part)`` of every part but the last that is not empty, in order, as an array of ``kind``."""
    many = F.size("_parts") - 1
    stretch = lambda first: F.slice("_parts", first + 1, F.least(F.lit(STRETCH), many - first))
    starts = _running(
        F.sequence(F.lit(0), many - 1, F.lit(STRETCH)),
        F.col("_offset"),
        lambda first: F.aggregate(stretch(first), F.lit(0).cast("long"), lambda n, part: n + F.length(part)),
        lambda at, first: F.struct(first.alias("first"), at.alias("at")),
        "struct<first:int,at:bigint>",
    )
    some = lambda at, part: F.when(part != "", each(at, part))
    places = F.flatten(F.transform(starts, lambda s: _running(stretch(s["first"]), s["at"], F.length, some, kind)))
    return F.when(many > 0, F.array_compact(places)).otherwise(F.array().cast(f"array<{kind}>"))


def sentence_ends(documents: DataFrame) -> DataFrame:
    """One row a document with its id and ``ends``: the places of the sentences' last characters, 0-based in code points.

    Null texts have no row; empty and blank ones, and texts without running text, have no ends. The order is that of the text.
    """
    return _marked(documents).select("doc_id", _places(lambda at, part: at + F.length(part) - 1, "bigint").alias("ends"))


def end_rows(documents: DataFrame) -> DataFrame:
    """One row a sentence: doc_id and ``end_pos``, the place of its last character.

    The outer form of explode, with its nulls left out after it: for the plain one the optimizer adds a filter on the
    array's size below, which works the whole array out a second time.
    """
    ends = sentence_ends(documents).select("doc_id", F.explode_outer("ends").alias("end_pos"))
    return ends.where("end_pos IS NOT NULL")


def sentences(documents: DataFrame) -> DataFrame:
    """One row a sentence: doc_id, ``number`` from 0, ``start_pos`` and ``end_pos`` (both included), ``sentence`` as it stands in the text.

    A sentence begins at the first character after the one before it that is neither blank nor markup that is no running text.
    """
    lead = rf"^{_UNSEEN}*+"
    spans = _places(
        lambda at, part: F.struct(
            (at + F.length(F.regexp_extract(part, lead, 0))).alias("start_pos"), (at + F.length(part) - 1).alias("end_pos")
        ),
        "struct<start_pos:bigint,end_pos:bigint>",
    )
    rows = _marked(documents).select("doc_id", "text", F.posexplode_outer(spans).alias("number", "_s"))
    return rows.where("number IS NOT NULL").select(
        "doc_id",
        "number",
        "_s.start_pos",
        "_s.end_pos",
        F.substr("text", (F.col("_s.start_pos") + 1).cast("int"), (F.col("_s.end_pos") - F.col("_s.start_pos") + 1).cast("int")).alias("sentence"),
    )
