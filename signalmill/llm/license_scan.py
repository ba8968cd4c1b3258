"""License scans: ordered signature rules with prefilter, priority and suppression.

A text is lower-cased (A-Z), reduced to its words joined by single spaces, and
searched by hand-written patterns over those words.  A rule runs only where its
keyword stands in the text, and no rule runs in a text without any keyword.  All
places are found, overlapping ones too; a detection that lies within another of
the same or a better tier is suppressed.

Everything is DataFrame functions on one row at a time: no join and no shuffle.

Defined results: a null text is an empty one: no words, no detections, score 0;
equal rows get equal results; columns of documents are kept, but may not be
named __lic_*.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """keyword: a literal, with its spaces, that every match holds. pattern: over words and single spaces.

    tier: 1 identifiers and full grants, 2 names with a version, 3 names of families,
    4 general notices. weight: the confidence that a detection gives.
    """

    label: str
    tier: int
    keyword: str
    pattern: str
    base: bool = False


TIER_WEIGHTS = {1: 1.0, 2: 0.9, 3: 0.7, 4: 0.4}
#: Phrases of the contract; their detections are counted whatever becomes of them.
BASE_PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def _rules() -> list[Rule]:
    out = [Rule(label, 4 if label == "reserved" else 3, f" {phrase} ", phrase, True) for phrase, label in BASE_PHRASES.items()]

    def add(label: str, tier: int, keyword: str, *patterns: str) -> None:
        out.extend(Rule(label, tier, keyword, p) for p in patterns)

    # SPDX tags: the words of an identifier, after its tag
    spdx = "spdx license identifier "
    for words, label in {
        "mit": "mit", "mit 0": "mit-0", "x11": "x11", "isc": "isc", "0bsd": "0bsd", "bsd 2 clause": "bsd-2-clause", "bsd 3 clause": "bsd-3-clause",
        "bsd 4 clause": "bsd-4-clause", "apache 1 0": "apache-1.0", "apache 1 1": "apache-1.1", "apache 2 0": "apache-2.0", "mpl 1 0": "mpl-1.0",
        "mpl 1 1": "mpl-1.1", "mpl 2 0": "mpl-2.0", "epl 1 0": "epl-1.0", "epl 2 0": "epl-2.0", "cddl 1 0": "cddl-1.0", "cddl 1 1": "cddl-1.1",
        "gpl 1 0 only": "gpl-1.0-only", "gpl 1 0 or later": "gpl-1.0-or-later", "gpl 2 0 only": "gpl-2.0-only", "gpl 2 0 or later": "gpl-2.0-or-later",
        "gpl 3 0 only": "gpl-3.0-only", "gpl 3 0 or later": "gpl-3.0-or-later", "gpl 2 0": "gpl-2.0", "gpl 3 0": "gpl-3.0",
        "lgpl 2 0 only": "lgpl-2.0-only", "lgpl 2 1 only": "lgpl-2.1-only", "lgpl 2 1 or later": "lgpl-2.1-or-later", "lgpl 3 0 only": "lgpl-3.0-only",
        "lgpl 3 0 or later": "lgpl-3.0-or-later", "lgpl 2 1": "lgpl-2.1", "lgpl 3 0": "lgpl-3.0", "agpl 3 0 only": "agpl-3.0-only",
        "agpl 3 0 or later": "agpl-3.0-or-later", "agpl 3 0": "agpl-3.0", "cc0 1 0": "cc0-1.0", "unlicense": "unlicense", "zlib": "zlib", "bsl 1 0": "boost-1.0",
        "wtfpl": "wtfpl", "ofl 1 1": "ofl-1.1", "artistic 1 0": "artistic-1.0", "artistic 2 0": "artistic-2.0", "python 2 0": "python-2.0",
        "psf 2 0": "psf-2.0", "postgresql": "postgresql", "ncsa": "ncsa", "upl 1 0": "upl-1.0", "eupl 1 1": "eupl-1.1", "eupl 1 2": "eupl-1.2",
        "osl 3 0": "osl-3.0", "afl 3 0": "afl-3.0", "ms pl": "ms-pl", "ms rl": "ms-rl", "blueoak 1 0 0": "blueoak-1.0.0", "mulanpsl 2 0": "mulanpsl-2.0",
        "busl 1 1": "busl-1.1", "sspl 1 0": "sspl-1.0", "elastic 2 0": "elastic-2.0", "ecl 2 0": "ecl-2.0", "curl": "curl", "openssl": "openssl",
        "libpng 2 0": "libpng-2.0", "ijg": "ijg", "vim": "vim", "ruby": "ruby", "php 3 01": "php-3.01", "zpl 2 1": "zpl-2.1", "w3c": "w3c",
        "lppl 1 3c": "lppl-1.3c", "odbl 1 0": "odbl-1.0", "odc by 1 0": "odc-by-1.0", "pddl 1 0": "pddl-1.0", "cecill 2 1": "cecill-2.1",
    }.items():
        add(label, 1, " spdx ", spdx + words)

    # Creative Commons: six kinds, in letters and in words, by version
    kinds = {
        "by": "attribution", "by sa": "attribution share ?alike", "by nc": "attribution non ?commercial", "by nd": "attribution no ?deriv(?:ative)?s",
        "by nc sa": "attribution non ?commercial share ?alike", "by nc nd": "attribution non ?commercial no ?deriv(?:ative)?s",
    }
    for letters, words in kinds.items():
        label = "cc-" + letters.replace(" ", "-")
        for version in ("1 0", "2 0", "2 5", "3 0", "4 0"):
            dotted = version.replace(" ", ".")
            add(f"{label}-{dotted}", 1, " cc by ", f"cc {letters} {version}(?: international| unported| generic)?")
            add(f"{label}-{dotted}", 1, " creativecommons ", f"creativecommons org licenses {letters} {version}")
            add(f"{label}-{dotted}", 1, " creative commons ", f"creative commons {words} {version}(?: international| unported| generic)?(?: public)?(?: license)?")
        if letters != "by":
            add(label, 2, " cc by ", f"cc {letters}")
        add(label, 2, " creative commons ", f"creative commons {words}(?: license)?")
    add("cc0-1.0", 1, " cc0 ", "cc0(?: 1 0)?(?: universal)?")
    add("cc0-1.0", 1, " creativecommons ", "creativecommons org publicdomain zero 1 0")
    add("cc-pdm-1.0", 1, " creativecommons ", "creativecommons org publicdomain mark 1 0")
    add("cc", 3, " creative commons ", "creative commons(?: public)?(?: license)?")

    # GNU: family, version and what later versions may do
    families = {"gpl": "(?:gnu )?general public license", "lgpl": "(?:gnu )?(?:lesser|library) general public license", "agpl": "(?:gnu )?affero general public license", "gfdl": "(?:gnu )?free documentation license"}
    for label, name in families.items():
        key = " free documentation license " if label == "gfdl" else " general public license "
        versions = {"gpl": ("1", "2", "3"), "lgpl": ("2", "2 1", "3"), "agpl": ("1", "3"), "gfdl": ("1 1", "1 2", "1 3")}[label]
        for version in versions:
            dotted = version.replace(" ", ".") if " " in version else version + ".0"
            v = version if " " in version else f"{version}(?: 0)?"
            add(f"{label}-{dotted}-or-later", 1, key, f"{name} (?:as published by the free software foundation )?(?:either )?version {v} (?:of the license )?or (?:at your option )?any later version", f"{name} v ?{v} or later")
            add(f"{label}-{dotted}-only", 1, key, f"{name} version {v} only", f"version {v} of the {name}")
            add(f"{label}-{dotted}", 2, key, f"{name} (?:version|v|ver) ?{v}", f"{name} (?:as published by the free software foundation )?version {v}")
            if label != "gfdl":
                add(f"{label}-{dotted}", 2, f" {label}", f"{label} ?v ?{v}", f"gnu {label} (?:version )?{v}", f"{label} version {v}")
        add(label, 2 if label != "gpl" else 3, key, name)
    add("gpl", 3, " gnu gpl ", "gnu gpl")
    add("lgpl", 3, " gnu lgpl ", "gnu lgpl")
    add("agpl", 3, " gnu agpl ", "gnu agpl")

    # permissive licences: their grants and names
    add("mit", 1, " permission is hereby granted ", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files")
    add("mit-x11", 1, " permission to use copy ", "permission to use copy modify distribute and sell this software and its documentation for any purpose")
    add("isc", 1, " permission to use copy ", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted")
    add("mit", 2, " mit license ", "(?:released |licensed |distributed |available )?under (?:the )?(?:terms of the )?mit license", "the mit license", "mit license")
    add("mit", 2, " expat license ", "expat license")
    add("x11", 2, " x11 license ", "x11 license")
    add("isc", 2, " isc license ", "isc license")
    add("bsd", 1, " redistribution and use ", "redistribution and use in source and binary forms with or without modification are permitted")
    add("bsd-3-clause", 1, " may be used to endorse ", "neither the name of (?:[^ ]+ ){1,12}nor the names of its contributors may be used to endorse or promote products")
    add("bsd-4-clause", 1, " all advertising materials ", "all advertising materials mentioning features or use of this software must display")
    for n, word in {"0": "zero", "2": "two", "3": "three", "4": "four"}.items():
        add(f"bsd-{n}-clause", 2, " clause ", f"bsd (?:{n}|{word}) clause(?: license)?", f"(?:{n}|{word}) clause bsd(?: license)?")
    add("bsd-2-clause", 2, " simplified bsd ", "simplified bsd(?: license)?")
    add("bsd-2-clause", 2, " freebsd license ", "freebsd license")
    add("bsd-3-clause", 2, " bsd ", "(?:new|modified|revised) bsd license")
    add("bsd", 3, " bsd license ", "bsd license")
    add("bsd", 3, " bsd style license ", "bsd style license")
    add("apache-2.0", 1, " apache license ", "licensed under the apache license version 2 0", "apache license version 2 0 january 2004")
    for v in ("1 0", "1 1", "2 0"):
        add(f"apache-{v.replace(' ', '.')}", 2, " apache ", f"apache (?:software )?license (?:version |v ?)?{v}", f"apache {v}(?: license)?")
    add("apache-2.0", 1, " www apache org ", "www apache org licenses license 2 0")
    add("apache", 3, " apache ", "apache (?:software )?license")
    add("boost-1.0", 2, " boost software ", "boost software license(?: version)?(?: 1 0)?")
    add("zlib", 1, " this software is provided as is ", "this software is provided as is without any express or implied warranty in no event will the authors be held liable")
    add("zlib", 2, " zlib ", "zlib (?:libpng )?license")
    add("libpng", 2, " libpng license ", "libpng license")
    add("ncsa", 2, " ncsa ", "(?:university of illinois )?ncsa open source license")
    add("unlicense", 1, " unencumbered ", "this is free and unencumbered software released into the public domain")
    add("unlicense", 2, " unlicense ", "the unlicense")
    add("wtfpl", 1, " public license ", "do what the f[^ ]* you want to public license")
    add("wtfpl", 2, " wtfpl ", "wtfpl")
    add("postgresql", 2, " postgresql license ", "postgresql license")
    add("upl-1.0", 2, " universal permissive ", "universal permissive license(?: v ?| version )?(?:1 0)?")
    add("python-2.0", 2, " python software foundation ", "python software foundation license(?: version 2)?")
    add("ruby", 2, " ruby license ", "ruby license")
    add("ruby", 2, " ruby s license ", "ruby s license")
    add("php-3.01", 2, " php license ", "php license(?: version)?(?: 3 01)?")
    add("perl", 2, " same terms as perl ", "under the same terms as perl itself")
    add("artistic-2.0", 2, " artistic license ", "artistic license (?:version )?2 0")
    add("artistic-1.0", 2, " artistic license ", "artistic license (?:version )?1 0")
    add("artistic", 3, " artistic license ", "artistic license")
    add("openssl", 2, " openssl license ", "openssl license")
    add("vim", 2, " vim license ", "vim license")
    add("w3c", 2, " w3c ", "w3c software (?:notice and )?license", "w3c document license")
    add("icu", 2, " icu license ", "icu license")
    add("unicode", 2, " unicode ", "unicode (?:inc )?license agreement")
    add("curl", 2, " curl license ", "curl license")
    add("ijg", 2, " independent jpeg group ", "this software is based in part on the work of the independent jpeg group")
    add("blueoak-1.0.0", 2, " blue oak ", "blue oak model license(?: version)?(?: 1 0 0)?")
    add("zpl", 2, " zope public license ", "zope public license(?: version)?(?: 2 [01])?")
    add("json", 1, " good not evil ", "the software shall be used for good not evil")
    add("beerware", 2, " beer", "beer ?ware license", "the beer ware license")

    # weak and network copyleft
    for v in ("1 0", "1 1", "2 0"):
        add(f"mpl-{v.replace(' ', '.')}", 2, " mozilla public license ", f"mozilla public license (?:version |v ?)?{v}")
        add(f"mpl-{v.replace(' ', '.')}", 2, " mpl ", f"mpl {v}")
    add("mpl-2.0", 1, " mozilla public license ", "subject to the terms of the mozilla public license v 2 0")
    add("mpl", 3, " mozilla public license ", "mozilla public license")
    for v in ("1 0", "2 0"):
        add(f"epl-{v.replace(' ', '.')}", 2, " eclipse public license ", f"eclipse public license (?:version |v ?)?{v}")
    add("epl", 3, " eclipse public license ", "eclipse public license")
    add("edl-1.0", 2, " eclipse distribution license ", "eclipse distribution license(?: v ?1 0)?")
    for v in ("1 0", "1 1"):
        add(f"cddl-{v.replace(' ', '.')}", 2, " common development ", f"common development and distribution license (?:version |v ?)?{v}")
    add("cddl", 3, " common development ", "common development and distribution license")
    add("cpl-1.0", 2, " common public license ", "common public license(?: version)?(?: 1 0)?")
    add("ipl-1.0", 2, " ibm public license ", "ibm public license(?: version)?(?: 1 0)?")
    for v in ("1 1", "1 2"):
        add(f"eupl-{v.replace(' ', '.')}", 2, " european union public ", f"european union public licen[cs]e (?:version |v ?)?{v}")
    add("eupl", 3, " european union public ", "european union public licen[cs]e")
    add("osl-3.0", 2, " open software license ", "open software license(?: version)?(?: 3 0)?")
    add("afl-3.0", 2, " academic free license ", "academic free license(?: version)?(?: 3 0)?")
    add("ecl-2.0", 2, " educational community license ", "educational community license(?: version)?(?: 2 0)?")
    add("cecill", 2, " cecill ", "cecill (?:free software )?license(?: agreement)?", "cecill [abc]", "cecill 2 [01]")
    add("mulanpsl-2.0", 2, " mulan ", "mulan permissive software license(?: version)?(?: v?2)?")
    add("ms-pl", 2, " microsoft public license ", "microsoft public license")
    add("ms-rl", 2, " microsoft reciprocal license ", "microsoft reciprocal license")
    add("apsl-2.0", 2, " apple public source ", "apple public source license(?: version)?(?: 2 0)?")
    add("npl", 2, " netscape public license ", "netscape public license(?: version)?(?: 1 [01])?")
    add("qpl-1.0", 2, " q public license ", "(?:the )?q public license(?: version)?(?: 1 0)?")
    add("sleepycat", 2, " sleepycat license ", "sleepycat license")
    add("lppl", 2, " latex project ", "latex project public license(?: version)?(?: 1 3[abc]?)?")

    # fonts, data and models
    add("ofl-1.1", 2, " sil open font ", "sil open font license(?: version)?(?: 1 [01])?")
    add("odbl-1.0", 2, " open database license ", "open database license(?: version)?(?: v?1 0)?")
    add("odc-by-1.0", 2, " open data commons ", "open data commons attribution license(?: version)?(?: v?1 0)?")
    add("pddl-1.0", 2, " open data commons ", "open data commons public domain dedication and license(?: version)?(?: v?1 0)?")
    add("cdla-permissive", 2, " community data license ", "community data license agreement permissive(?: version)?(?: [12] 0)?")
    add("cdla-sharing", 2, " community data license ", "community data license agreement sharing(?: version)?(?: 1 0)?")
    add("ogl", 2, " open government licen", "open government licen[cs]e(?: version)?(?: v?[123] 0)?")
    add("openrail", 2, " openrail", "(?:creativeml |bigscience )?openrail ?[dams]*(?: license)?")

    # source available and closed
    add("busl-1.1", 2, " business source license ", "business source license(?: version)?(?: 1 [01])?")
    add("sspl-1.0", 2, " server side public license ", "server side public license(?: version)?(?: 1)?")
    add("elastic-2.0", 2, " elastic license ", "elastic license(?: version)?(?: 2 0)?")
    add("commons-clause", 2, " commons clause ", "commons clause(?: license)?(?: condition)?")
    add("polyform", 2, " polyform ", "polyform (?:noncommercial|small business|shield|strict|perimeter|internal use)(?: license)?")
    add("proprietary", 2, " proprietary ", "proprietary and confidential", "confidential and proprietary", "proprietary license")
    add("proprietary", 3, " unauthorized ", "unauthorized (?:copying|use|distribution|reproduction) (?:of this file |or distribution )?(?:via any medium )?is strictly prohibited")
    add("eula", 3, " end user license ", "end user license agreement")

    # general notices
    add("public-domain", 3, " public domain ", "(?:released |placed |dedicated )?(?:in|into|to) the public domain", "public domain dedication")
    add("copyright", 4, " copyright ", "copyright (?:c )?(?:19|20)[0-9][0-9](?: (?:19|20)[0-9][0-9])?")
    add("reserved", 4, " some rights reserved ", "some rights reserved")
    add("as-is", 4, " as is ", "provided as is without (?:any )?(?:express or implied )?warrant(?:y|ies)")
    add("license-reference", 4, " license ", "see (?:the )?license (?:file )?for (?:more )?details", "subject to the terms of the license", "licensed under the [^ ]+ license")
    add("license-reference", 4, " licensed under ", "(?:this work is )?licensed under")
    add("dual", 4, " dual licensed ", "dual licensed under")
    return out


RULES = _rules()


def _literal(rules: list[Rule]) -> Column:
    """All rules as one constant array of structs."""
    quote = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.expr("array(" + ",".join(f"named_struct('rule',{i},'tier',{r.tier},'keyword',{quote(r.keyword)},'cut',{quote(f'(?= {r.pattern} )')},'whole',{quote(f'^ {r.pattern}(?= )')})" for i, r in enumerate(rules)) + ")")


def normal_words(text: Column) -> Column:
    """The lower-cased words of a text, each after a space, and a space at the end; ' ' for none.

    Other than A-Z, only the Kelvin sign and the dotted I lower to ASCII letters; they
    are word characters, so any other word character may stand for them.
    """
    plain = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("é")), F.lit("İ"), F.lit("é"))
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(plain), F.lit(" ")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")


def _count(text: Column, part: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))


SPAN = "array<struct<start:int,end:int,tier:int,rule:int>>"


def detections(words: Column, rules: list[Rule]) -> Column:
    """All places of the rules in words, a column of normal_words(): start and end count words.

    A text is cut before each place of a rule; the spaces in the pieces before a place
    count its words, and the match that begins there has one space a word.
    """
    # a mark in front, as no cut is made before the first character
    marked = F.concat(F.lit("\n"), words)

    def of_rule(r: Column) -> Column:
        zero = F.struct(F.lit(-1).alias("n"), F.lit(0).alias("chars"), F.array().cast(SPAN).alias("found"))

        def add(acc: Column, piece: Column) -> Column:
            match = F.call_function("regexp_extract", F.substr(marked, acc["chars"] + 1), r["whole"], F.lit(0))
            span = F.struct(acc["n"].alias("start"), (acc["n"] + _count(match, " ")).alias("end"), r["tier"].alias("tier"), r["rule"].alias("rule"))
            return F.struct(
                (F.greatest(acc["n"], F.lit(0)) + _count(piece, " ")).alias("n"),
                (acc["chars"] + F.length(piece)).alias("chars"),
                F.when(acc["n"] < 0, acc["found"]).otherwise(F.concat(acc["found"], F.array(span))).alias("found"),
            )

        return F.aggregate(F.split(marked, r["cut"], -1), zero, add, lambda acc: acc["found"])

    return F.flatten(F.transform(F.filter(_literal(rules), lambda r: F.contains(words, r["keyword"])), of_rule))


def unsuppressed(spans: Column) -> Column:
    """Spans that lie in no other of the same or a better tier; of equals, the earlier rule stays.

    In order of start, then falling end, whatever may hold a span comes before it, so
    the furthest end so far of each tier and those better decides.
    """
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("to"), s["tier"].alias("tier"), s["rule"].alias("rule"))))
    zero = F.struct(*[F.lit(-1).alias(f"m{t}") for t in TIER_WEIGHTS], F.array().cast(SPAN).alias("kept"))

    def add(acc: Column, s: Column) -> Column:
        end = -s["to"]
        held = F.lit(False)
        for t in TIER_WEIGHTS:
            held = held | ((s["tier"] == t) & (acc[f"m{t}"] >= end))
        span = F.struct(s["start"].alias("start"), end.alias("end"), s["tier"].alias("tier"), s["rule"].alias("rule"))
        return F.struct(
            *[F.when(s["tier"] <= t, F.greatest(acc[f"m{t}"], end)).otherwise(acc[f"m{t}"]).alias(f"m{t}") for t in TIER_WEIGHTS],
            F.when(held, acc["kept"]).otherwise(F.concat(acc["kept"], F.array(span))).alias("kept"),
        )

    return F.aggregate(ordered, zero, add, lambda acc: acc["kept"])


def anchors(rules: list[Rule]) -> list[str]:
    """Few literals, of which every keyword holds one: long words, or else the whole keyword."""
    left, out = {r.keyword for r in rules}, []
    while left:
        words = [w for k in left for w in (x for x in k.split() if len(x) >= 6)]
        best = max(sorted(set(words)), key=words.count, default=None)
        if best is None:
            return out + sorted(left)
        out.append(best)
        left = {k for k in left if best not in k}
    return out


def scanned(documents: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """All columns of documents and __lic_n_words, __lic_found (all detections), __lic_kept (those not suppressed)."""
    words = F.col("__lic_words")
    out = documents.withColumn("__lic_words", normal_words(F.col("text")))
    gate = F.lit(False)
    for a in anchors(rules):
        gate = gate | F.contains(words, F.lit(a))
    out = out.withColumn("__lic_n_words", (_count(words, " ") - 1).cast("bigint"))
    out = out.withColumn("__lic_found", F.when(gate, detections(words, rules)).otherwise(F.array().cast(SPAN))).drop("__lic_words")
    return out.withColumn("__lic_kept", F.when(F.size("__lic_found") > 0, unsuppressed(F.col("__lic_found"))).otherwise(F.array().cast(SPAN)))


def labels_of(spans: Column, rules: list[Rule] = RULES) -> Column:
    """The distinct labels of spans, sorted."""
    names = F.expr("array(" + ",".join(f"'{r.label}'" for r in rules) + ")")
    return F.array_sort(F.array_distinct(F.transform(spans, lambda s: F.element_at(names, s["rule"] + 1))))


def score_of(spans: Column) -> Column:
    """The weight of the best tier among spans, 0 without any."""
    best = F.array_min(F.transform(spans, lambda s: s["tier"]))
    weights = F.array(*[F.lit(w) for _, w in sorted(TIER_WEIGHTS.items())])
    return F.when(best.isNull(), F.lit(0.0)).otherwise(F.element_at(weights, best))


def base_spans(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["rule"] < len(BASE_PHRASES))
