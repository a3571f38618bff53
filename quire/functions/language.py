"""Language functions that need Python: transliteration, hyphenation, sentences. All are Arrow batch functions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cyrillic letters in Latin.
CYRILLIC = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e e zh z i i k l m n o p r s t u f kh ts ch sh shch _ y _ e iu ia".split(), strict=True))
LETTERS = {k: "" if v == "_" else v for k, v in CYRILLIC.items()} | dict(zip("äöüßàáâãåçèéêëìíîïñòóôõùúûýø", "a o u ss a a a a a c e e e e i i i i n o o o o u u u y o".split(), strict=True))


def transliterate_word(word: str) -> str:
    """ASCII letters and digits of a word, with the word's capitals; a word of which nothing is left stays."""
    slug = re.sub("[^a-z0-9]+", "-", "".join(LETTERS.get(c, c) for c in word.lower())).strip("-")
    if not slug:
        return word
    letters = [c for c in word if c.isalpha()]
    if letters and all(c.isupper() for c in letters):
        return slug.upper()
    return slug[0].upper() + slug[1:] if word[:1].isupper() else slug


def transliterate(text: Column) -> Column:
    """Each word in ASCII, runs of white space as one space; null stays."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else " ".join(map(transliterate_word, t.split())))

    return run(text)


class Hyphenator:
    """Patterns of letters and digits: odd digits allow a break, the highest digit at a place decides."""

    def __init__(self, patterns: list[str], exceptions: list[str] = (), left: int = 2, right: int = 2):
        self.left, self.right = left, right
        self.patterns = {re.sub("[0-9]", "", p): [int(x or 0) for x in re.split("[^0-9]", p)] for p in patterns}
        self.exceptions = {e.replace("-", ""): e.split("-") for e in exceptions}
        self.longest = max(map(len, self.patterns), default=0)

    def word(self, word: str) -> list[str]:
        if (low := word.lower()) in self.exceptions:
            out, at = [], 0
            for p in self.exceptions[low]:
                out.append(word[at : at + len(p)])
                at += len(p)
            return out
        marked = f".{low}."
        points = [0] * (len(marked) + 1)
        for i in range(len(marked)):
            for j in range(i + 1, min(len(marked), i + self.longest) + 1):
                for k, v in enumerate(self.patterns.get(marked[i:j], ())):
                    points[i + k] = max(points[i + k], v)
        cuts = [i for i in range(self.left, len(word) - self.right + 1) if points[i + 1] % 2]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)]

    def text(self, text: str, hyphen: str = "­") -> str:
        return re.sub(r"[^\W\d_]+", lambda m: hyphen.join(self.word(m[0])), text)


def hyphenate(text: Column, patterns: list[str], exceptions: list[str] = (), hyphen: str = "­") -> Column:
    """Text with soft hyphens; null stays. The patterns, some thousand short strings, travel with the function."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        h = Hyphenator(patterns, exceptions)
        return s.map(lambda t: None if t is None else h.text(t, hyphen))

    return run(text)


_END = re.compile(r"[.!?…]+[\"'»”)\]]*\s+(?=[\"'«“(\[]*[^\W\d_a-zа-яё])")


def split_sentences(text: str) -> list[str]:
    """Sentences; the white space after one belongs to it, so they concatenate to the text."""
    at, out = 0, []
    for m in _END.finditer(text):
        out.append(text[at : m.end()])
        at = m.end()
    return [*out, text[at:]] if at < len(text) or not out else out


def sentences(text: Column) -> Column:
    """Array of sentences; null stays."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else split_sentences(t))

    return run(text)


#: Languages by their own names.
OWN_NAMES = {"english": "en", "русский": "ru", "українська": "uk", "беларуская": "be", "deutsch": "de", "français": "fr", "español": "es", "italiano": "it", "português": "pt", "polski": "pl", "čeština": "cs", "slovenčina": "sk", "български": "bg", "српски": "sr", "hrvatski": "hr", "magyar": "hu", "română": "ro", "nederlands": "nl", "svenska": "sv", "dansk": "da", "norsk": "no", "suomi": "fi", "eesti": "et", "latviešu": "lv", "lietuvių": "lt", "ελληνικά": "el", "türkçe": "tr", "עברית": "he", "العربية": "ar", "中文": "zh", "日本語": "ja", "한국어": "ko"}
_TAG = r"^[A-Za-z]{2,3}(?:[-_][A-Za-z]{4})?(?:[-_](?:[A-Za-z]{2}|[0-9]{3}))?(?:[-_][A-Za-z0-9]{4,8})*$"


def book_language(text: Column) -> Column:
    """A language tag with hyphens and usual case, or the tag of a language that is given by its own name; und for anything else."""
    s = F.replace(F.trim(F.coalesce(text, F.lit(""))), F.lit("_"), F.lit("-"))
    parts = F.split(s, "-")
    usual = F.array_join(F.transform(parts, lambda x, i: F.when(i == 0, F.lower(x)).when(F.length(x) == 4, F.initcap(x)).when(F.length(x) == 2, F.upper(x)).otherwise(F.lower(x))), "-")
    named = F.try_element_at(F.create_map(*(F.lit(x) for kv in OWN_NAMES.items() for x in kv)), F.lower(F.trim(F.coalesce(text, F.lit("")))))
    return F.coalesce(named, F.when(s.rlike(_TAG), usual), F.lit("und"))


def model_for(tag: Column, known: list[str], mapped: dict[str, str] | None = None) -> Column:
    """Which of the known models (dictionaries of hyphenation or sentences) serves a language: its own, that which its tag maps to, then the same for the tag without region and script. Null without one."""
    there = lambda c: F.when(c.isin(known), c) if known else F.lit(None).cast("string")
    to = (lambda c: F.try_element_at(F.create_map(*(F.lit(x) for kv in mapped.items() for x in kv)), c)) if mapped else (lambda c: F.lit(None).cast("string"))
    base = F.split_part(tag, F.lit("-"), F.lit(1))
    return F.coalesce(there(tag), there(to(tag)), there(base), there(to(base)))


def anchored(words: DataFrame, word: str, patterns: DataFrame, pattern: str, value: str) -> DataFrame:
    """words with each pattern that one of their places begins: place (from 0 on), pattern, value.

    Each distinct word gives its substrings of the lengths that patterns have, which meet the patterns by
    equality; what was found goes back to the words.
    """
    n, size = F.length(word), F.length(pattern)
    lengths = patterns.where(size > 0).agg(F.sort_array(F.collect_set(size)).alias("__lengths"))  # one row
    t = words.select(word).distinct().join(F.broadcast(lengths))
    t = t.withColumn("place", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1))))
    t = t.withColumn("__n", F.explode(F.filter("__lengths", lambda x: x <= n - F.col("place"))))
    t = t.select(word, "place", F.substring(F.col(word), F.col("place") + 1, F.col("__n")).alias(pattern))
    # merged: estimates leave out what explode adds, so the substrings could be taken for small and be broadcast
    found = t.hint("merge").join(patterns.select(pattern, value), pattern)
    return words.join(found, word).select(*words.columns, "place", pattern, value)
