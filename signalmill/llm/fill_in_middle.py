"""Fill-in-middle examples: a text is cut at two seeded places, and its middle moves behind the rest.

A unit pattern says where a text may be cut; by default a unit is a code point.  The
regex library finds the units from left to right, and their end offsets go into a
compact array (4 bytes a unit), of which two look-ups slice the text.  Seeds and digests are SHA-256.

Defined results: a null text is the empty one, which stays plain; so does a text that
holds a sentinel.  A null key seeds as an empty one.  What no unit covers goes with the unit after it, and at
the end with the suffix.  Texts are cut whole, however long; equal rows give equal rows; an
empty table gives an empty one; extra columns stay, and all new ones begin with __fim_.
"""

from __future__ import annotations

import hashlib
from array import array
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import trimmed

PLAIN, PSM, SPM = "plain", "psm", "spm"
CODE_POINT = "(?s:.)"
#: Units that the library reports in one match: their ends come out in C, and no more of them are kept as objects.
STRIDE = 256


@dataclass(frozen=True)
class Cut:
    """How texts are cut: of 100 texts `rate` in the mean are, and of 100 of those `spm` with the suffix first."""

    seed: int = 1
    unit: str = CODE_POINT
    rate: int = 90
    spm: int = 20
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        for a in self.sentinels:
            for b in self.sentinels:
                if not a or (a is not b and a in b) or any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)) + (a is not b and len(a) != len(b)))):
                    raise ValueError(f"sentinels {a!r} and {b!r} can't be told apart")

    @property
    def sentinels(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle

    def draws(self, key: str) -> tuple[int, ...]:
        """Four numbers of 32 bits, from the seed and a key."""
        digest = hashlib.sha256(f"{self.seed}:{key}".encode()).digest()
        return tuple(int.from_bytes(digest[k : k + 4], "big") for k in range(0, 16, 4))


def unit_ends(pattern: regex.Pattern, text: str) -> array:
    """Where each unit of the text ends, in ascending order."""
    ends = array("I")
    for match in pattern.finditer(text):
        ends.extend(match.ends("__unit"))
    return ends


def unit_pattern(unit: str) -> regex.Pattern:
    """Up to STRIDE units in a row; possessive, so that each is matched as it would be alone."""
    if regex.compile(unit).match(""):
        raise ValueError("a unit can't be empty")
    return regex.compile(f"(?P<__unit>{unit}){{1,{STRIDE}}}+")


def cut(text: str, key: str, how: Cut, pattern: regex.Pattern) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of prefix and of middle, output)."""
    ends = unit_ends(pattern, text)
    n = len(ends)
    h1, h2, h3, h4 = how.draws(key)
    if not text or h3 % 100 >= how.rate or any(s in text for s in how.sentinels):
        return n, PLAIN, None, None, text
    first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (first, last))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < how.spm:
        return n, SPM, a, b - a, f"{how.suffix}{suffix}{how.prefix}{prefix}{how.middle}{middle}"
    return n, PSM, a, b - a, f"{how.prefix}{prefix}{how.suffix}{suffix}{how.middle}{middle}"


def put_back(output: str, form: str, how: Cut) -> str:
    """The text that an output was made of."""
    if form == PLAIN:
        return output
    first, second = (how.suffix, how.prefix) if form == SPM else (how.prefix, how.suffix)
    a, _, rest = output.removeprefix(first).partition(second)
    b, _, middle = rest.partition(how.middle)
    return b + middle + a if form == SPM else a + middle + b


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def transformed(documents: DataFrame, how: Cut = Cut(), *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """documents with __fim_n, __fim_form, __fim_prefix_chars, __fim_middle_chars, __fim_output and __fim_output_sha256."""

    @F.pandas_udf("n bigint, form string, prefix_chars bigint, middle_chars bigint, output string, output_sha256 string")
    def work(keys: pd.Series, texts: pd.Series) -> pd.DataFrame:
        pattern = unit_pattern(how.unit)
        rows = [(*done, _sha256(done[-1])) for done in (cut(t, k, how, pattern) for k, t in zip(keys, texts, strict=True))]
        out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"])
        trimmed()
        return out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    full = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    fields = ("n", "form", "prefix_chars", "middle_chars", "output", "output_sha256")
    out = documents.withColumn("__fim", work(full(key), full(text)))
    return out.select(*documents.columns, *[F.col("__fim")[f].alias(f"__fim_{f}") for f in fields])


def restored(outputs: DataFrame, how: Cut = Cut()) -> DataFrame:
    """outputs with __fim_restored, the text rebuilt from __fim_output and __fim_form alone, and __fim_restored_sha256."""

    @F.pandas_udf("restored string, restored_sha256 string")
    def work(texts: pd.Series, forms: pd.Series) -> pd.DataFrame:
        whole = [put_back(t, f, how) for t, f in zip(texts, forms, strict=True)]
        return pd.DataFrame({"restored": whole, "restored_sha256": [_sha256(t) for t in whole]})

    out = outputs.withColumn("__fim", work("__fim_output", "__fim_form"))
    return out.select(*outputs.columns, *[F.col("__fim")[f].alias(f"__fim_{f}") for f in ("restored", "restored_sha256")])
