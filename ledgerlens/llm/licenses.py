"""License scans by ordered signature rules.

A rule is a regular expression with a keyword, a priority and a label. Most texts hold no keyword
and are done after one search; for the others only the rules of the keywords they hold are run. Of
overlapping detections, one that lies inside another of higher priority, or of equal priority and
greater length, is suppressed. Everything happens inside the row: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import ALNUM_CUT
from ledgerlens.llm.spans import let, spans

# The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: label, keyword, name as it stands in running text (words by single spaces), identifier.
FAMILIES = (
    ("mit", "mit", r"(?:the )?(?:mit|expat)(?: x11)?", "mit"),
    ("apache-1.1", "apache", r"(?:the )?apache(?: software)?(?: license)? ?(?:version |v)?1 1", "apache 1 1"),
    ("apache-2", "apache", r"(?:the )?apache(?: software)?(?: license)? ?(?:version |v)?2(?: 0)?", "apache 2 0"),
    ("bsd-2-clause", "bsd", r"(?:the )?(?:simplified bsd|bsd 2 clause|2 clause bsd|freebsd)", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", r"(?:the )?(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd)", "bsd 3 clause"),
    ("bsd", "bsd", r"(?:the |a )?bsd(?: style)?", "bsd"),
    ("isc", "isc", r"(?:the )?isc", "isc"),
    ("agpl-3", "affero", r"(?:the )?(?:gnu )?affero general public license ?(?:version |v)?3(?: 0)?", "agpl 3 0(?: only| or later)?"),
    ("lgpl-2.1", "lesser", r"(?:the )?(?:gnu )?lesser general public license ?(?:version |v)?2 1", "lgpl 2 1(?: only| or later)?"),
    ("lgpl-3", "lesser", r"(?:the )?(?:gnu )?lesser general public license ?(?:version |v)?3(?: 0)?", "lgpl 3 0(?: only| or later)?"),
    ("gpl-2", "general public", r"(?:the )?(?:gnu )?general public license ?(?:version |v)?2(?: 0)?", "gpl 2 0(?: only| or later)?"),
    ("gpl-3", "general public", r"(?:the )?(?:gnu )?general public license ?(?:version |v)?3(?: 0)?", "gpl 3 0(?: only| or later)?"),
    ("gpl", "general public", r"(?:the )?(?:gnu )?general public license", "gpl"),
    ("gpl-2", "gpl", r"(?:the )?(?:gnu )?gpl ?v?2(?: 0)?", "gpl 2"),
    ("gpl-3", "gpl", r"(?:the )?(?:gnu )?gpl ?v?3(?: 0)?", "gpl 3"),
    ("mpl-1.1", "mozilla", r"(?:the )?mozilla public license ?(?:version |v)?1 1", "mpl 1 1"),
    ("mpl-2", "mozilla", r"(?:the )?mozilla public license ?(?:version |v)?2(?: 0)?", "mpl 2 0"),
    ("epl-1", "eclipse", r"(?:the )?eclipse public license ?(?:version |v)?1(?: 0)?", "epl 1 0"),
    ("epl-2", "eclipse", r"(?:the )?eclipse public license ?(?:version |v)?2(?: 0)?", "epl 2 0"),
    ("cddl-1", "cddl", r"(?:the )?cddl ?(?:version |v)?1(?: 0)?", "cddl 1 0"),
    ("artistic-2", "artistic", r"(?:the )?artistic(?: license)? ?(?:version |v)?2(?: 0)?", "artistic 2 0"),
    ("zlib", "zlib", r"(?:the )?zlib(?: libpng)?", "zlib"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", "unlicense"),
    ("wtfpl", "wtfpl", r"(?:the )?wtfpl", "wtfpl"),
    ("boost-1", "boost", r"(?:the )?boost software license ?(?:version |v)?1(?: 0)?", "bsl 1 0"),
    ("cc0-1", "cc0", r"(?:the )?(?:creative commons )?cc0 ?(?:version |v)?1(?: 0)?", "cc0 1 0"),
    ("cc-by", "cc by", r"(?:the |a )?(?:creative commons )?cc by(?! nc| sa| nd)(?: [1-4] [05])?", "cc by [1-4] [05]"),
    ("cc-by-sa", "cc by sa", r"(?:the |a )?(?:creative commons )?cc by sa(?: [1-4] [05])?", "cc by sa [1-4] [05]"),
    ("cc-by-nd", "cc by nd", r"(?:the |a )?(?:creative commons )?cc by nd(?: [1-4] [05])?", "cc by nd [1-4] [05]"),
    ("cc-by-nc", "cc by nc", r"(?:the |a )?(?:creative commons )?cc by nc(?! sa| nd)(?: [1-4] [05])?", "cc by nc [1-4] [05]"),
    ("cc-by-nc-sa", "cc by nc sa", r"(?:the |a )?(?:creative commons )?cc by nc sa(?: [1-4] [05])?", "cc by nc sa [1-4] [05]"),
    ("cc-by-nc-nd", "cc by nc nd", r"(?:the |a )?(?:creative commons )?cc by nc nd(?: [1-4] [05])?", "cc by nc nd [1-4] [05]"),
)
#: How a license is named, with the priority: the surer the wording, the higher.
WORDINGS = (
    (95, "spdx license identifier {id}"), (90, "licensed under {name}(?: licen[cs]e)?"), (90, "released under {name}(?: licen[cs]e)?"),
    (90, "distributed under {name}(?: licen[cs]e)?"), (90, "available under {name}(?: licen[cs]e)?"),
    (88, "under the terms of {name}(?: licen[cs]e)?"), (85, "subject to {name}(?: licen[cs]e)?"),
    (85, "covered by {name}(?: licen[cs]e)?"), (80, "licen[cs]e {name}"), (75, "{name} licen[cs]ed"),
    (60, "under {name}(?: licen[cs]e)?"), (55, "{name} licen[cs]e"),
)
#: Texts of the licenses themselves: label, keyword, expression, priority.
BODIES = (
    ("mit", "permission is hereby", "permission is hereby granted free of charge to any person obtaining a copy", 100),
    ("isc", "permission to use", "permission to use copy modify and or distribute this software for any purpose", 100),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted", 98),
    ("unlicense", "public domain", "free and unencumbered software released into the public domain", 100),
    ("public-domain", "public domain", "(?:placed|dedicated|released) (?:in|into|to) the public domain", 70),
    ("proprietary", "all rights reserved", "all rights reserved", 30),
)


def rules() -> list[tuple[str, str, str, int]]:
    """(label, keyword, expression, priority) of every rule, the surest first."""
    made = [(label, key, wording.format(name=name, id=ident), priority)
            for priority, wording in WORDINGS for label, key, name, ident in FAMILIES]
    return sorted([*BODIES, *made], key=lambda r: -r[3])


def normal(text: Column) -> Column:
    """The words by single spaces, with one before and after; matching ignores case instead of lowering."""
    return F.regexp_replace(F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" ")), ALNUM_CUT.replace(r"\x60", r"\x40\x5B-\x60"), " ")


def n_spaces(x: Column) -> Column:
    return (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))).cast("long")


def detections(line: Column) -> Column:
    """array<struct<start,stop,label,priority>> after suppression; places are characters of `line`."""
    keys: dict[str, list] = {}
    for label, key, expression, priority in rules():
        keys.setdefault(key, []).append((label, rf"(?i)(?<= ){expression}(?= )", priority))
    listed = F.array(*[
        F.struct(F.lit(k).alias("key"), F.array(*[F.struct(F.lit(a).alias("label"), F.lit(p).alias("pattern"), F.lit(n).alias("priority")) for a, p, n in rs]).alias("rules"))
        for k, rs in keys.items()])
    kind = "array<struct<start:bigint,stop:bigint,label:string,priority:int>>"

    def scan(low: Column) -> Column:
        live = F.flatten(F.transform(F.filter(listed, lambda g: F.contains(low, F.concat(F.lit(" "), g["key"]))), lambda g: g["rules"]))
        found = F.flatten(F.transform(live, lambda r: F.transform(spans(low, r["pattern"]), lambda x: F.struct(
            x["start"].alias("start"), x["stop"].alias("stop"), r["label"].alias("label"), r["priority"].alias("priority")))))
        return let(F.array_distinct(found), suppressed)

    gate = line.rlike("(?i) (?:" + "|".join(keys) + ")")
    return F.when(gate, let(F.lower(line), scan)).otherwise(F.array().cast(kind))


def suppressed(found: Column) -> Column:
    """Detections that lie in no other of higher priority, or of equal priority and greater length."""
    def inside(x: Column, y: Column) -> Column:
        longer = y["stop"] - y["start"] > x["stop"] - x["start"]
        surer = y["priority"] > x["priority"]
        return (y["start"] <= x["start"]) & (y["stop"] >= x["stop"]) & (surer | ((y["priority"] == x["priority"]) & longer))

    return F.filter(found, lambda x: ~F.exists(found, lambda y: inside(x, y)))


def base_facts(line: Column) -> Column:
    """struct<n, first, last, labels> of the base phrases; places in words, from 0."""
    # The words before a match are the spaces before it, less the first.
    def word(x: Column) -> Column:
        return n_spaces(F.substring(line, F.lit(1), x["start"].cast("int"))) - 1

    def places(label: str) -> Callable[[Column], Column]:
        return lambda f: F.struct(F.size(f).cast("long").alias("n"), word(f[0]).alias("first"), word(F.element_at(f, -1)).alias("last"), F.lit(label).alias("label"))

    patterns = {label: rf"(?i)(?<= ){phrase}(?= )" for phrase, label in BASE.items()}
    parts = [F.when(line.rlike(p), let(spans(line, p), places(label))) for label, p in patterns.items()]
    present = F.filter(F.array(*parts), lambda x: x.isNotNull())
    return let(present, lambda p: F.struct(
        F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + x["n"]).alias("n"), F.array_min(F.transform(p, lambda x: x["first"])).alias("first"),
        F.array_max(F.transform(p, lambda x: x["last"])).alias("last"), F.transform(p, lambda x: x["label"]).alias("labels")))


def scan_licenses(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` without the text, with (n_words, base, detections, labels, score).

    `detections` are places in the normal form of the text, after suppression. `labels` are the
    base phrases' and the rules', distinct and sorted; `score` is the highest priority as a share of
    100, 1 for a base phrase, 0 without any. Null and empty texts have no words and no detection.
    Columns named like the new ones are replaced.
    """
    line = normal(F.col(text))
    kept = [c for c in docs.columns if c != text]
    out = docs.withColumn("_scan", let(line, lambda x: F.struct(
        (n_spaces(x) - 1).alias("n_words"), base_facts(x).alias("base"), detections(x).alias("detections"))))
    out = out.withColumns({"n_words": F.col("_scan.n_words"), "base": F.col("_scan.base"), "detections": F.col("_scan.detections")})
    found = F.transform("detections", lambda x: x["label"])
    best = F.coalesce(F.array_max(F.transform("detections", lambda x: x["priority"])) / 100.0, F.lit(0.0))
    out = out.withColumn("labels", F.array_sort(F.array_distinct(F.concat(F.col("base.labels"), found))))
    out = out.withColumn("score", F.when(F.col("base.n") > 0, 1.0).otherwise(best))
    return out.select(*[c for c in kept if c not in ("n_words", "base", "detections", "labels", "score")], "n_words", "base", "detections", "labels", "score")
