"""Fill-in-the-middle rewriting of documents at line bounds.

A pandas UDF gets Arrow batches of texts. In each text the regex library's finditer gives the ends of its units (lines with
their line feed), kept in a compact array; two look-ups there give the code points at which the text is sliced into prefix,
middle and suffix. hashlib computes the seed that picks the cuts and the form from the doc_id alone, so a lost task gives
the same rows again, and the digests. Rows are independent: one pass, no shuffle.

Null text counts as empty; an empty text stays plain, and so does one that holds a mark, so that a rewritten text can always
be taken apart again. A null doc_id is seeded as an empty string. Equal rows give equal results. An empty table gives an
empty result. Columns besides doc_id and text are ignored. A text is handled whole, in memory of a few times its size (four
bytes a code point at most, eight for each unit), in one worker.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import keyed_text

#: Marks of a prefix, a suffix and a middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
LINES = r"[^\n]*\n|[^\n]+"

FIELDS = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"


@dataclass(frozen=True)
class Infill:
    """unit: pattern of a unit; rate, spm: per cent of texts that are rewritten, and of those with the suffix first."""

    unit: str = LINES
    seed: int = 7
    rate: int = 100
    spm: int = 50

    def draws(self, key: str | None) -> tuple[int, int, int, int]:
        digest = hashlib.sha256(f"{self.seed}:{key or ''}".encode()).hexdigest()
        return tuple(int(digest[k : k + 8], 16) for k in range(0, 32, 8))

    def ends(self, text: str) -> array:
        """0, then the end of each unit."""
        return array("q", [0]) + array("q", (m.end() for m in regex.finditer(self.unit, text)))

    def rewrite(self, key: str | None, text: str | None) -> tuple[int, str, int | None, int | None, str]:
        """Number of units, form, code points of prefix and middle (None if plain), output."""
        text = text or ""
        ends = self.ends(text)
        n, draws = len(ends) - 1, self.draws(key)
        if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or draws[2] % 100 >= self.rate:
            return n, "plain", None, None, text
        low, high = (ends[k] for k in sorted(x % (n + 1) for x in draws[:2]))
        prefix, middle, suffix = text[:low], text[low:high], text[high:]
        if draws[3] % 100 < self.spm:
            return n, "spm", low, high - low, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
        return n, "psm", low, high - low, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def restore(output: str, form: str) -> str:
    """The text that an output was made from."""
    if form == "plain":
        return output
    first, second = (SUFFIX, PREFIX) if form == "spm" else (PREFIX, SUFFIX)
    a, rest = output[len(first) :].split(second, 1)
    b, middle = rest.split(MIDDLE, 1)
    return b + middle + a if form == "spm" else a + middle + b


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def rewritten(options: Infill, key: Column, text: Column) -> Column:
    """A struct of FIELDS."""
    names = [f.split()[0] for f in FIELDS.split(", ")]

    @F.pandas_udf(FIELDS)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for keys, texts in batches:
            rows = [options.rewrite(k, t) for k, t in zip(keys, texts, strict=True)]
            out = pd.DataFrame([(*r, sha256(r[-1])) for r in rows], columns=names)
            yield out.astype({"n": "int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    return run(key.cast("string"), text)


@F.pandas_udf(StringType())
def restored(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The text that an output of a form was made from."""
    for outputs, forms in batches:
        yield pd.Series([restore(o, f) for o, f in zip(outputs, forms, strict=True)], dtype=object)


@F.pandas_udf(StringType())
def restored_sha256(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Digest of the text that an output of a form was made from."""
    for outputs, forms in batches:
        yield pd.Series([sha256(restore(o, f)) for o, f in zip(outputs, forms, strict=True)], dtype=object)


def fill_in_middle(docs: DataFrame, options: Infill = Infill()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output, output_sha256."""
    rows = keyed_text(docs)
    return rows.select("doc_id", rewritten(options, rows["doc_id"], rows["text"]).alias("_fim")).select("doc_id", "_fim.*")


#: The same in SQL, with the digests of the query.
SQL = rf"""
with units as (
  select doc_id, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') u, sha256('7:' || coalesce(cast(doc_id as varchar), '')) s
  from documents),
drawn as (
  select *, len(u) n, cast('0x' || s[1:8] as bigint) h1, cast('0x' || s[9:16] as bigint) h2, cast('0x' || s[25:32] as bigint) h4 from units),
cut as (
  select *, array_to_string(u[1:least(h1 % (n + 1), h2 % (n + 1))], '') p, array_to_string(u[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') m,
    array_to_string(u[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') x,
    case when t = '' or contains(t, '{PREFIX}') or contains(t, '{SUFFIX}') or contains(t, '{MIDDLE}') then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end form
  from drawn),
written as (
  select *, case form when 'plain' then t when 'spm' then '{SUFFIX}' || x || '{PREFIX}' || p || '{MIDDLE}' || m else '{PREFIX}' || p || '{SUFFIX}' || x || '{MIDDLE}' || m end o from cut)
select doc_id, n, form, case when form <> 'plain' then length(p) end prefix_chars, case when form <> 'plain' then length(m) end middle_chars, sha256(o) output_sha256,
  sha256(case form when 'plain' then o
    when 'spm' then o[strpos(o, '{PREFIX}') + 3:strpos(o, '{MIDDLE}') - 1] || o[strpos(o, '{MIDDLE}') + 3:] || o[4:strpos(o, '{PREFIX}') - 1]
    else o[4:strpos(o, '{SUFFIX}') - 1] || o[strpos(o, '{MIDDLE}') + 3:] || o[strpos(o, '{SUFFIX}') + 3:strpos(o, '{MIDDLE}') - 1] end) restored_sha256
from written
"""
