"""Materials in texts: markup of formulas, mentions, families and snippets of evidence."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from papertide.operators.entities import ELEMENTS, NO_FORMULAS, by_field, phrase_hits

# An acronym that counts as a formula; confidences of a mention in the title and in the abstract.
ALLOWED_FORMULAS = ("YBCO",)
IN_TITLE, IN_ABSTRACT = 0.98, 0.74
_FORMULA = r"(?<![A-Za-z0-9])((?:[A-Z][a-z]?(?:[0-9]+(?:\.[0-9]+)?)?){2,})(?![A-Za-z0-9])"
#: Whether a text can hold markup or a formula with blanks: all others pass as they are.
_MAYBE = r"[<&_₀-₉]|[A-Z][A-Za-z0-9]*\s+[0-9]|[0-9]\s+[A-Z]"
_SMALL = str.maketrans("₀₁₂₃₄₅₆₇₈₉", "0123456789")
_PART = re.compile(r"[A-Z][a-z]?(?:[0-9]+(?:\.[0-9]+)?)?")
_NUMBER = re.compile(r"[0-9]+(?:\.[0-9]+)?")
_TOKEN = re.compile(r"[A-Za-z0-9.]+|\s+|[^A-Za-z0-9.\s]+")


def valid_formula(value: Column) -> Column:
    """A formula of known elements, 4 to 32 characters, no small molecule; without digits at most three elements."""
    symbols = F.regexp_extract_all(value, F.lit("([A-Z][a-z]?)"), F.lit(1))
    shape = value.rlike(r"^(?:[A-Z][a-z]?(?:[0-9]+(?:\.[0-9]+)?)?){2,}$") & F.length(value).between(4, 32) & ~value.isin(*NO_FORMULAS)
    known = F.forall(symbols, lambda s: s.isin(*ELEMENTS))
    plural = (F.size(symbols) == 3) & (F.get(symbols, F.lit(2)) == "Cs") & (F.get(symbols, F.lit(0)) != "Cs")
    short = value.rlike("[0-9]") | ((F.size(symbols) <= 3) & ~F.coalesce(plural, F.lit(False)))
    return value.isin(*ALLOWED_FORMULAS) | (shape & known & short)


def _is_formula(word: str) -> bool:
    """What ``valid_formula`` tells, for one word."""
    symbols = re.findall("[A-Z][a-z]?", word)
    if word in ALLOWED_FORMULAS:
        return True
    if not 4 <= len(word) <= 32 or word in NO_FORMULAS or len(symbols) < 2 or _PART.sub("", word) or not set(symbols) <= set(ELEMENTS):
        return False
    return any(c.isdigit() for c in word) or len(symbols) < 3 or (len(symbols) == 3 and not (symbols[2] == "Cs" != symbols[0]))


class _Pieces(HTMLParser):
    """Reads a text as pieces: plain text, subscripts (the number in ``sub``, or the ``mn`` of a ``msub``) and gaps (all other tags)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.pieces: list[tuple[str, str]] = []
        self.inside: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        name = tag.rpartition(":")[2]
        if name in ("sub", "msub") or (self.inside and name in ("mi", "mn")):
            self.inside.append(name)
        else:
            self.pieces.append(("gap", " "))

    def handle_endtag(self, tag: str) -> None:
        name = tag.rpartition(":")[2]
        if name in self.inside:
            while self.inside.pop() != name:
                pass
        else:
            self.pieces.append(("gap", " "))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.pieces.append(("gap", " "))

    def handle_data(self, data: str) -> None:
        lowest = self.inside[-1] if self.inside else ""
        if lowest in ("sub", "mn") and _NUMBER.fullmatch(data.strip()):
            self.pieces.append(("sub", data.strip()))
        elif lowest == "mi":
            self.pieces.append(("text", data.strip()))
        elif lowest != "msub" or data.strip():
            self.pieces.append(("text", data))

    def handle_entityref(self, name: str) -> None:
        self.handle_data(f"&{name}")

    def handle_charref(self, name: str) -> None:
        self.handle_data(f"&#{name}")


def _lowered(text: str) -> Iterator[tuple[str, str]]:
    """Plain text as text and subscripts that an underscore marks, braces, dollars and name commands around them left out."""
    while "_" in text:
        head, _, tail = text.partition("_")
        braced = tail.startswith("{")
        number = _NUMBER.match(tail, 1 if braced else 0)
        base = head.rstrip("$ ") if number else head
        command = base.rfind("\\") if base.endswith("}") else -1
        name = base[command:].partition("{")[2].rstrip("}") if command >= 0 and base[command:].startswith(("\\mathrm{", "\\text{")) else ""
        if name.isalnum():
            base = base[:command].removesuffix("{") + name
        if not number or not (base[-1:].isascii() and base[-1:].isalnum()):
            yield "text", head + "_"
            text = tail
            continue
        yield "text", base
        yield "sub", number[0]
        text = tail[number.end() :]
        text = text.removeprefix("}") if braced else text
        text = text[1:] if text.startswith("$") and head.rstrip(" ").endswith("$") else text
    yield "text", text


def _joined(out: list[str], number: str) -> None:
    """Puts a subscript to the word that ``out`` ends in: a whole number behind a complete formula that ends in a digit names a polymorph and goes."""
    text = "".join(out).rstrip()
    base = re.search(r"[A-Za-z0-9]*$", text)[0]
    first = re.search("[A-Z]", base)
    if first is None:
        out.append(number)
        return
    known = base[-1].isdigit() and number.isdigit() and _is_formula(base[first.start() :])
    out[:] = [text, "" if known else number]


def _closed(text: str) -> str:
    """Without the blanks of formulas that a publisher has spaced: words of elements, each with its number, two such pairs or
    two elements at least; or behind a formula that ends in a digit."""
    tokens = _TOKEN.findall(text)
    shaped = lambda t: bool(re.fullmatch("(?:[A-Z][a-z]?)+", t))
    number = lambda t: bool(re.fullmatch("[0-9.]+", t))
    out, i = [], 0
    while i < len(tokens):
        parts, j, elements = [], i, 0
        if re.fullmatch(r"[A-Z][A-Za-z0-9]*[0-9]", tokens[i]):
            parts, j, elements = [tokens[i]], i + 2, 1
        pairs = 0
        while j + 2 < len(tokens) and (j == i or tokens[j - 1].isspace()) and shaped(tokens[j]) and tokens[j + 1].isspace() and number(tokens[j + 2]):
            parts += [tokens[j], tokens[j + 2]]
            elements += len(re.findall("[A-Z]", tokens[j]))
            pairs, j = pairs + 1, j + 4
        if pairs and elements > 1:
            out.append("".join(parts))
            i = j - 1
        else:
            out.append(tokens[i])
            i += 1
    return "".join(out)


def flat_text(text: str) -> str:
    """One text without formula markup."""
    reader = _Pieces()
    reader.feed(html.unescape(text).translate(_SMALL))
    rest = reader.rawdata  # what looks like a tag that never ends
    reader.rawdata = ""
    pieces = [*reader.pieces, ("text", rest)]
    out: list[str] = []
    for kind, value in pieces:
        for k, v in _lowered(value) if kind == "text" else [(kind, value)]:
            if k == "sub":
                tail = [out.pop() if out else ""]
                _joined(tail, v)
                out += ["".join(tail)]
            elif v:
                # words that stand together are one piece, so that a subscript finds all of its base
                if out and k == "text" and out[-1][-1:].isalnum() and v[:1].isalnum():
                    out[-1] += v
                else:
                    out.append(v)
    return _closed("".join(out))


@F.pandas_udf(StringType())
def _flat(values: pd.Series) -> pd.Series:
    return values.map(flat_text, na_action="ignore")


def flatten_markup(text: Column) -> Column:
    """Formulas without markup: entities, small digits, MathML, LaTeX, ``<sub>`` and blanks before numbers; other tags become blanks.
    A whole number after a formula that is complete and ends in a digit names a polymorph and goes. Only texts that may hold markup or a spaced formula cross to
    Python; null is the empty text."""
    known = F.coalesce(text, F.lit(""))
    return F.coalesce(_flat(F.when(known.rlike(_MAYBE), known)), known)


def flattened(docs: DataFrame) -> DataFrame:
    return docs.withColumns({c: flatten_markup(F.col(c)) for c in ("title", "abstract")})


def extract_materials(docs: DataFrame, registry: DataFrame) -> DataFrame:
    """doc_id, material, confidence, detector of flattened texts, a row for each material of a document.

    ``registry`` holds (alias, material, kind): kind ``phrase`` names a class of materials, ``alias`` a material; aliases of fewer than four
    characters are found as formulas only. Of several mentions the surest counts (title before abstract), of equals alias, phrase, formula.
    """
    formula = F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(_FORMULA), F.lit(1))))
    found = by_field(docs).select("doc_id", "field", formula.alias("term")).filter(valid_formula(F.col("term")))
    known = registry.filter("kind = 'alias'").select(F.lower("alias").alias("_k"), "material").dropDuplicates(["_k"])
    formulas = found.withColumn("_k", F.lower("term")).join(known, "_k", "left").select("doc_id", "field", F.coalesce("material", "term").alias("material"), F.lit(0).alias("rank"))
    phrases = registry.filter("kind = 'phrase' or length(alias) >= 4").select(F.col("alias").alias("phrase"), "material", F.when(F.col("kind") == "phrase", 1).otherwise(2).alias("rank"))
    named = phrase_hits(by_field(docs), phrases).select("doc_id", "field", "material", "rank")
    kinds = F.array(F.lit("formula_ner_"), F.lit("registry_phrase_"), F.lit("registry_alias_"))
    rows = formulas.union(named).withColumn("confidence", F.when(F.col("field") == "title", IN_TITLE).otherwise(IN_ABSTRACT))
    rows = rows.withColumn("detector", F.concat(F.get(kinds, F.col("rank")), "field"))
    return rows.groupBy("doc_id", "material").agg(F.max("confidence").alias("confidence"), F.max_by("detector", F.struct("confidence", "rank")).alias("detector"))


def family(material: Column, registered: Column) -> Column:
    """The registered family, else one by the elements of the name."""
    holds = lambda *xs: F.exists(F.array(*map(F.lit, xs)), lambda e: F.contains(material, e))
    return F.coalesce(registered, F.when(holds("O"), "paper-extracted oxide").when(holds("S", "Se", "Te"), "paper-extracted chalcogenide").when(holds("P", "As", "Sb", "N"), "paper-extracted pnictide").otherwise("paper-extracted material"))


def material_evidence(docs: DataFrame, found: DataFrame, families: DataFrame, before: int = 110, after: int = 190, start: int = 360) -> DataFrame:
    """doc_id, material, family, source, field, snippet: where the text names the material, with ``before`` and ``after`` characters around
    it; the first ``start`` characters where it does not. ``families`` (material, family) is a dimension."""
    named = found.join(families, "material", "left").withColumn("family", family(F.col("material"), F.col("family")))
    rows = named.join(docs.select("doc_id", "title", "abstract"), "doc_id")
    in_title = F.endswith("detector", F.lit("_title")) | F.contains(F.lower("title"), F.lower("material"))
    rows = rows.withColumn("field", F.when(in_title, "title").otherwise("abstract"))
    rows = rows.withColumn("_text", F.trim(F.regexp_replace(F.when(F.col("field") == "title", F.col("title")).otherwise(F.col("abstract")), r"\s+", " ")))
    rows = rows.withColumn("_at", F.expr("locate(lower(material), lower(_text))"))
    cut = F.substring(F.col("_text"), F.greatest(F.lit(1), F.col("_at") - before), F.col("_at") + F.length("material") + after - F.greatest(F.lit(1), F.col("_at") - before))
    return rows.select(
        "doc_id", "material", "family", F.when(F.startswith("detector", F.lit("formula_ner")), "paper_text_formula").otherwise("paper_text_registry").alias("source"), "field",
        F.when(F.col("_at") > 0, cut).otherwise(F.substring("_text", 1, start)).alias("snippet"),
    )
