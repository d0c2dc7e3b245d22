"""Text normal forms, tokens, shingles and similarity as native columns.

Six normal forms exist; they differ on purpose and must not be merged.  Those
that need Unicode compatibility forms or full case folding use one Arrow UDF.
"""

from __future__ import annotations

import json
import math
import unicodedata
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Word and CJK classes and fences that results must agree on.
_WORD = r"[\p{L}\p{N}_]+"
_TOKEN = r"[\p{L}\p{N}]+"
_CJK = r"[㐀-䶿一-鿿豈-﫿]"
_CODE_FENCE = r"(?i)```(?:tsx|typescript|jsx|javascript|ts|js)\s*\n([\s\S]*?)```"
_HTML_FENCE = r"(?is)^```(?:html)?\s*(.*?)\s*```$"
# End of fixed values.


def collapsed(text: Column) -> Column:
    """N1: white space runs to one space, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def worded(text: Column) -> Column:
    """N2: lower case word runs joined by one space."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0)), " ")


def newlined(text: Column) -> Column:
    """N6: CRLF and CR to LF, trimmed."""
    return F.btrim(F.regexp_replace(text, r"\r\n?", "\n"), F.lit(" \t\n\r\x0b\f"))


@F.pandas_udf(T.StringType())
def nfkc_casefold(text: pd.Series) -> pd.Series:
    """N4: NFKC, full case folding, white space runs to one space."""
    return text.map(lambda t: None if t is None else " ".join(unicodedata.normalize("NFKC", t).casefold().split()))


@F.pandas_udf(T.StringType())
def casefolded(text: pd.Series) -> pd.Series:
    """N3: full case folding, white space runs to one space."""
    return text.map(lambda t: None if t is None else " ".join(t.casefold().split()))


def tokens(text: Column) -> Column:
    """N5 without compatibility forms: lower case letter and digit runs; a run that is
    all CJK by character."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(_TOKEN), F.lit(0))
    split = F.flatten(F.transform(runs, lambda t: F.when(t.rlike(f"^{_CJK}+$"), F.split(t, "")).otherwise(F.array(t))))
    return F.when(text.rlike(_CJK), split).otherwise(runs)


def exact_tokens(text: Column) -> Column:
    """N5 in full: compatibility forms and case folding first."""
    return tokens(nfkc_casefold(text))


def ngrams(words: Column, size: int) -> Column:
    """Distinct n-grams of a token array, each joined by a space; none if it is shorter."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (size - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, size), " "))
    return F.when(F.size(words) >= size, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def containment(a: Column, b: Column) -> Column:
    """Shared share of the smaller of two distinct arrays; 0 if one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of the union of two distinct arrays; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks, as difflib has it without its junk heuristic."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b)], dtype="float64")


def common_subsequence(a: str, b: str, least: int = 0) -> int:
    """Length of the longest common subsequence, or a number below least if it is below.

    A bit a letter of a, one step a letter of b.  The matching blocks of two texts are
    a common subsequence, so they never hold more.
    """
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    free = full
    for done, c in enumerate(b):
        met = free & where.get(c, 0)
        if met:
            free = (free + met | free - met) & full
        if done % 64 == 63 and (most := len(a) - free.bit_count() + len(b) - done - 1) < least:
            return most
    return len(a) - free.bit_count()


def ratio_from(threshold: float):
    """A column function: `sequence_ratio` where it reaches the threshold, else null.  The
    blocks are only looked for where the common subsequence leaves a chance."""

    @F.pandas_udf(T.DoubleType())
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            least = math.ceil(threshold * (len(x or "") + len(y or "")) / 2 - 1e-9)
            if x is None or y is None or not x + y or common_subsequence(x, y, least) < least:
                return None
            found = SequenceMatcher(None, x, y, autojunk=False).ratio()
            return found if found >= threshold else None

        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")

    return ratio


def length_bound(a: Column, b: Column) -> Column:
    """No sequence ratio is above this."""
    la, lb = F.length(a), F.length(b)
    return F.when(la + lb > 0, 2.0 * F.least(la, lb) / (la + lb)).otherwise(F.lit(0.0))


def stable_id(prefix: str, value: Column) -> Column:
    """prefix_ and the first 20 hex digits of SHA-256."""
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(value, 256), 1, 20))


def set_digest(values: Column) -> Column:
    """SHA-256 of the sorted distinct strings as a JSON array."""
    return F.sha2(F.to_json(F.array_sort(F.array_distinct(values))), 256)


@F.pandas_udf(T.StringType())
def canonical_json(raw: pd.Series) -> pd.Series:
    """JSON text with sorted keys and no blanks, non-ASCII kept; null if it is no JSON."""

    def one(text):
        try:
            return None if text is None else json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        except ValueError:
            return None

    return raw.map(one)


@F.pandas_udf(T.StringType())
def first_json_object(raw: pd.Series) -> pd.Series:
    """The first complete JSON object inside prose or a fence, canonical; null if none."""
    decoder = json.JSONDecoder()

    def one(text):
        at = text.find("{") if text is not None else -1
        while at >= 0:
            try:
                value, _ = decoder.raw_decode(text, at)
            except ValueError:
                value = None
            if isinstance(value, dict):
                return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
            at = text.find("{", at + 1)
        return None

    return raw.map(one)


def only_fenced_code(raw: Column) -> Column:
    """The text of the one TS or JS fence; null unless there is exactly one, not blank."""
    blocks = F.regexp_extract_all(raw, F.lit(_CODE_FENCE), F.lit(1))
    code = newlined(F.get(blocks, F.lit(0)))
    return F.when((F.size(blocks) == 1) & (code != ""), code)


def html_answer(raw: Column) -> Column:
    """The HTML inside an answer that is one fence, else the trimmed text."""
    text = F.btrim(raw, F.lit(" \t\n\r\x0b\f"))
    return F.when(text.rlike(_HTML_FENCE), F.btrim(F.regexp_extract(text, _HTML_FENCE, 1), F.lit(" \t\n\r\x0b\f"))).otherwise(text)
