"""Keywords against every alternative of their patterns."""

import re

from signalmill.llm import license_scan

try:
    from re import _parser as parser
except ImportError:  # before Python 3.11
    import sre_parse as parser


def texts(parsed):
    """Texts that a parsed pattern matches: every branch, and repeats at their fewest and one more."""
    out = [""]
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            more = [chr(arg)]
        elif name in ("IN", "NOT_LITERAL", "ANY"):
            more = [chr(x) for o, x in arg if str(o) == "LITERAL"] if name == "IN" and str(arg[0][0]) != "NEGATE" else ["z"]
            more = more or ["1"]
        elif name == "BRANCH":
            more = [t for branch in arg[1] for t in texts(branch)]
        elif name == "SUBPATTERN":
            more = texts(arg[3])
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            low, high, inner = arg
            more = [t * n for n in {low, min(low + 1, int(high))} for t in texts(inner)]
        else:
            raise AssertionError(name)
        out = sorted({a + b for a in out for b in more})
    return out


def test_keywords_stand_in_every_alternative():
    wrong = []
    for r in license_scan.RULES:
        for t in texts(parser.parse(r.pattern)):
            assert re.fullmatch(r.pattern, t), (r.pattern, t)
            if r.keyword not in f" {t} ":
                wrong.append((r.label, r.keyword, t))
    assert not wrong, wrong


def test_beerware_in_one_word(spark):
    rows = [(1, "Under the Beerware License."), (2, "the beer-ware license"), (3, "a beer without license")]
    out = license_scan.scanned(spark.createDataFrame(rows, "doc_id long, text string"))
    spans = [c for c in out.columns if c not in ("doc_id", "text")]
    got = {r.doc_id: r.labels for r in out.select("doc_id", license_scan.labels_of(out[spans[-1]]).alias("labels")).collect()}
    assert {d for d, x in got.items() if "beerware" in x} == {1, 2}
