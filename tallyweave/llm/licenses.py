"""License scans: ordered signature rules over normalised words. Native DataFrame operations only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import spared

# Rules are regular expressions over lower-case words with single spaces between them; they start and end at words.
# Names of licenses by label: the first is the SPDX-like identifier in words, the others are names in running text.
NAMES = {
    "0bsd": ["0bsd", "bsd zero clause license", "zero clause bsd license", "free public license 1 0 0"],
    "afl": ["afl 3 0", "academic free license(?: version [0-9 ]+)?"],
    "agpl-3.0": ["agpl 3 0(?: only| or later)?", "(?:gnu )?affero general public license(?: version 3)?", "gnu agpl(?: v3| 3 0)?"],
    "apache-1.1": ["apache 1 1", "apache (?:software )?license version 1 1"],
    "apache-2.0": ["apache 2 0", "apache license (?:version 2 0|v2(?: 0)?|2 0)", "apache software license 2 0"],
    "artistic": ["artistic 2 0", "(?:perl )?artistic license(?: 2 0| version 2 0)?"],
    "beerware": ["beerware", "beer ?ware license"],
    "bsd-1-clause": ["bsd 1 clause", "bsd 1 clause license"],
    "bsd-2-clause": ["bsd 2 clause", "(?:bsd 2 clause|simplified bsd|freebsd|2 clause bsd) license"],
    "bsd-3-clause": ["bsd 3 clause", "(?:bsd 3 clause|new bsd|modified bsd|revised bsd|3 clause bsd) license"],
    "bsd-4-clause": ["bsd 4 clause", "(?:bsd 4 clause|original bsd|4 clause bsd) license"],
    "bsd": ["bsd", "(?:berkeley )?bsd(?: style)? license"],
    "bsl-1.0": ["bsl 1 0", "boost software license(?: version 1 0)?"],
    "busl-1.1": ["busl 1 1", "business source license(?: 1 1)?"],
    "cc0-1.0": ["cc0 1 0", "creative commons (?:cc0|zero)(?: 1 0)?(?: universal)?", "cc0 1 0 universal license"],
    "cc-by-4.0": ["cc by 4 0", "creative commons attribution (?:4 0|4)(?: international)?(?: license)?"],
    "cc-by-3.0": ["cc by 3 0", "creative commons attribution (?:3 0|3)(?: unported)?(?: license)?"],
    "cc-by-2.0": ["cc by 2 0", "creative commons attribution (?:2 0|2)(?: generic)?(?: license)?"],
    "cc-by-sa-4.0": ["cc by sa 4 0", "creative commons attribution share ?alike 4 0(?: international)?(?: license)?"],
    "cc-by-sa-3.0": ["cc by sa 3 0", "creative commons attribution share ?alike 3 0(?: unported)?(?: license)?"],
    "cc-by-nd": ["cc by nd 4 0", "creative commons attribution no ?deriv(?:ative)?s(?: [0-9] 0)?(?: international)?(?: license)?"],
    "cc-by-nc": ["cc by nc 4 0", "creative commons attribution non ?commercial(?: [0-9] 0)?(?: international)?(?: license)?"],
    "cc-by-nc-sa": ["cc by nc sa 4 0", "creative commons attribution non ?commercial share ?alike(?: [0-9] 0)?(?: international)?(?: license)?"],
    "cc-by-nc-nd": ["cc by nc nd 4 0", "creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [0-9] 0)?(?: international)?(?: license)?"],
    "cc": ["cc", "creative commons(?: attribution)? license"],
    "cddl-1.0": ["cddl 1 0", "common development and distribution license(?: version)?(?: 1 0)?"],
    "cecill": ["cecill 2 1", "cecill(?: b| c)? (?:free software )?license(?: agreement)?"],
    "cpl-1.0": ["cpl 1 0", "common public license(?: version)?(?: 1 0)?"],
    "cpal-1.0": ["cpal 1 0", "common public attribution license(?: version)?(?: 1 0)?"],
    "curl": ["curl", "curl license"],
    "ecl-2.0": ["ecl 2 0", "educational community license(?: version)?(?: 2 0)?"],
    "epl-1.0": ["epl 1 0", "eclipse public license(?: version| v)? 1 0"],
    "epl-2.0": ["epl 2 0", "eclipse public license(?: version| v)? 2 0"],
    "eupl": ["eupl 1 2", "european union public license(?: version)?(?: 1 [12])?", "eupl license"],
    "fsfap": ["fsfap", "fsf all permissive license"],
    "ftl": ["ftl", "freetype (?:project )?license"],
    "gfdl": ["gfdl 1 3(?: only| or later)?", "(?:gnu )?free documentation license(?: version 1 [123])?"],
    "gpl-1.0": ["gpl 1 0(?: only| or later)?", "(?:gnu )?general public license version 1", "gpl v1"],
    "gpl-2.0": ["gpl 2 0(?: only| or later)?", "(?:gnu )?general public license (?:version 2|v2)(?: 0)?", "(?:gnu )?gpl ?v2(?: 0)?"],
    "gpl-3.0": ["gpl 3 0(?: only| or later)?", "(?:gnu )?general public license (?:version 3|v3)(?: 0)?", "(?:gnu )?gpl ?v3(?: 0)?"],
    "hpnd": ["hpnd", "historical permission notice and disclaimer"],
    "icu": ["icu", "icu license"],
    "ijg": ["ijg", "independent jpeg group license"],
    "ipa": ["ipa", "ipa font license"],
    "ipl-1.0": ["ipl 1 0", "ibm public license(?: version)?(?: 1 0)?"],
    "isc": ["isc", "isc license"],
    "json": ["json", "json license"],
    "lgpl-2.0": ["lgpl 2 0(?: only| or later)?", "(?:gnu )?library general public license(?: version 2)?"],
    "lgpl-2.1": ["lgpl 2 1(?: only| or later)?", "(?:gnu )?lesser general public license version 2 1", "(?:gnu )?lgpl ?v?2 1"],
    "lgpl-3.0": ["lgpl 3 0(?: only| or later)?", "(?:gnu )?lesser general public license version 3", "(?:gnu )?lgpl ?v3"],
    "lgpl": ["lgpl", "(?:gnu )?lesser general public license", "gnu lgpl"],
    "libpng": ["libpng 2 0", "(?:lib)?png(?: reference library)? license(?: version 2)?"],
    "lppl": ["lppl 1 3c", "latex project public license(?: 1 3[ac]?)?"],
    "miros": ["miros", "miros license"],
    "mit-0": ["mit 0", "mit no attribution license", "mit 0 license"],
    "mit": ["mit", "(?:the )?(?:expat|x11) license", "mit x11 license"],
    "mpl-1.1": ["mpl 1 1", "mozilla public license(?: version| v)? 1 1"],
    "mpl-2.0": ["mpl 2 0", "mozilla public license(?: version| v)?(?: 2 0)?"],
    "ms-pl": ["ms pl", "microsoft public license(?: ms pl)?"],
    "ms-rl": ["ms rl", "microsoft reciprocal license(?: ms rl)?"],
    "mulanpsl-2.0": ["mulanpsl 2 0", "mulan permissive software license(?: v2| version 2)?"],
    "ncsa": ["ncsa", "(?:university of illinois )?ncsa open source license"],
    "odbl-1.0": ["odbl 1 0", "open (?:data commons open )?database license(?: odbl)?"],
    "odc-by": ["odc by 1 0", "open data commons attribution license"],
    "ofl-1.1": ["ofl 1 1", "sil open font license(?: version)?(?: 1 1)?"],
    "openssl": ["openssl", "openssl license"],
    "osl-3.0": ["osl 3 0", "open software license(?: version| v)?(?: 3 0)?"],
    "pddl": ["pddl 1 0", "public domain dedication and license"],
    "php": ["php 3 01", "php license(?: version)?(?: 3 01?)?"],
    "postgresql": ["postgresql", "postgresql licen[cs]e"],
    "psf-2.0": ["psf 2 0", "python software foundation license(?: version 2)?", "psf license(?: agreement)?"],
    "qpl-1.0": ["qpl 1 0", "q public license(?: version)?(?: 1 0)?"],
    "ruby": ["ruby", "ruby license"],
    "sleepycat": ["sleepycat", "sleepycat license"],
    "sspl-1.0": ["sspl 1 0", "server side public license(?: version)?(?: 1)?"],
    "unicode": ["unicode 3 0", "unicode (?:dfs )?license(?: agreement)?(?: v3)?"],
    "unlicense": ["unlicense", "the unlicense", "unlicense license"],
    "upl-1.0": ["upl 1 0", "universal permissive license(?: version)?(?: 1 0)?"],
    "vim": ["vim", "vim license"],
    "w3c": ["w3c", "w3c software (?:notice and )?license"],
    "wtfpl": ["wtfpl", "wtfpl(?: license)?", "do what the [a-z]+ you want to public license"],
    "x11": ["x11", "x consortium license"],
    "zlib": ["zlib", "zlib(?: libpng)? license"],
    "zpl": ["zpl 2 1", "zope public license(?: version)?(?: 2 [01])?"],
}
# Passages of license texts and notices, which name no license.
TEXTS = {
    "apache-2.0": ["licensed under the apache license", "you may not use this file except in compliance with the license"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted", "redistributions of source code must retain the above copyright notice"],
    "bsd-3-clause": ["neither the name of .{1,80}? may be used to endorse or promote products derived from this software without specific prior written permission"],
    "cc": ["www creativecommons org licenses", "creativecommons org licenses [a-z ]{2,9}", "this work is licensed under a creative commons"],
    "cc0-1.0": ["creativecommons org publicdomain zero 1 0"],
    "copyright": ["copyright(?: c)? (?:19|20)[0-9]{2}", "all rights reserved", "copyright(?: c)? [0-9]{4} [0-9]{4}"],
    "gpl": ["this program is free software you can redistribute it and or modify it", "gnu org licenses gpl(?: [0-9] [0-9])?", "(?:gnu )?gpl license", "gnu gpl"],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "lgpl": ["gnu org licenses lgpl(?: [0-9] [0-9])?"],
    "mit": ["permission is hereby granted free of charge to any person obtaining a copy", "opensource org licenses mit"],
    "no-warranty": ["without warranty of any kind express or implied", "as is without warranty of any kind", "without any warranty without even the implied warranty"],
    "proprietary": ["proprietary and confidential", "proprietary license", "unauthorized (?:copying|redistribution) of this (?:file|software) .{0,40}?is strictly prohibited"],
    "public-domain": ["(?:released|dedicated|placed) (?:in|in to|into|to) the public domain", "is in the public domain", "public domain dedication"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
    "wtfpl": ["you just do what the [a-z]+ you want to license"],
}
BASE = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
# A text without any of these can match no rule.
GATES = ("licen", "copyright", "spdx", "gpl", "warrant", "domain", "creative", "permission", "redistribut", "reserved", "wtfpl", "proprietary", "prohibited")
ADDED = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")
CONFIDENCE = {1: 0.6, 2: 0.8, 3: 0.95}
WORD, GAP = r"[\p{Alnum}\x{80}-\x{10FFFF}]+", r"[^\p{Alnum}\x{80}-\x{10FFFF}]+"  # p{Alnum}: ASCII only


def rules() -> list[tuple[str, str, int, str]]:
    """(label, keyword, priority, regex): identifiers after an SPDX tag, then grants by name and passages, then names."""
    found = []
    for label, (spdx, *names) in NAMES.items():
        found.append((label, "spdx license identifier", 3, f"spdx license identifier {spdx}"))
        found.append((label, "license", 2, f"(?:license|licence|licensed under) (?:is )?{spdx}"))
        for name in names:
            found.append((label, _keyword(name), 2, f"(?:licensed|released|distributed|available|published) under (?:a |the )?(?:terms of (?:a |the )?)?{name}"))
            found.append((label, _keyword(name), 1, name))
    for label, passages in TEXTS.items():
        found.extend((label, _keyword(p), 2, p) for p in passages)
    found.extend((label, phrase, 1, phrase) for label, phrase in BASE.items())
    for label, keyword, _, pattern in found:
        if not any(gate in keyword for gate in GATES):
            raise ValueError(f"no gate lets {label}: {pattern} through")
    return found


def _keyword(pattern: str) -> str:
    """The longest stretch of plain words outside of groups that every match of the pattern has and a gate knows."""
    plain, depth = [""], 0
    for i, c in enumerate(pattern):
        depth += (c in "([{") - (c in ")]}")
        if depth == 0 and (c.isalnum() or c == " "):
            if pattern[i + 1 : i + 2] in ("?", "*", "{"):
                plain.append("")
            else:
                plain[-1] += c
        elif plain[-1]:
            plain.append("")
    known = [p.strip() for p in plain if any(g in p.strip() for g in GATES)]
    if not known:
        raise ValueError(f"no keyword in {pattern}")
    return max(known, key=len)


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _places(words: Column, pattern: Column) -> Column:
    """Places of a regex in normalised words: array of (start, end), counted in words, end exclusive. Matches are marked in
    the text and the marks found again among its words, so the work is in proportion to the text however many there are."""
    marked = F.regexp_replace(words, pattern, F.lit("\x01$0\x02"))
    parts = F.split(marked, F.lit(" "))
    at = lambda sign, lag: F.array_compact(F.transform(parts, lambda w, i: F.when(sign(w), i + lag)))
    starts = at(lambda w: F.startswith(w, F.lit("\x01")), -1)  # a space stands before the first word
    ends = at(lambda w: F.endswith(w, F.lit("\x02")), 0)
    empty = F.array().cast("array<struct<start:int,end:int>>")
    return F.when(marked == words, empty).otherwise(F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), b.alias("end"))))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """License findings of each whole text: the columns of (doc_id, text) plus n_words, n_base, first_word, last_word,
    base_labels, detections and labels, score; other columns are kept.

    Words are runs of letters, digits and non-ASCII characters, A-Z as a-z. Of rules whose keyword occurs, all places
    count; one that lies within a place of a rule of higher priority, or within a longer one of the same priority, is
    suppressed. ``labels`` are those of the remaining places and of all base phrases, distinct, sorted and joined by
    commas. Null and empty texts have no words and no label; repeated rows are scanned alike. Columns named like added ones
    are replaced; an empty table gives none.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ADDED])
    names, docs = docs.columns, spared(docs, {"_lower", "_words", "_sorted", "_found", "_base", "_kept"})
    text = F.coalesce(F.col("text"), F.lit(""))
    lower = docs.withColumn("_lower", F.lower(text))
    gate = F.lit(False)
    for word in GATES:
        gate = gate | F.col("_lower").contains(word)
    ascii_lower = F.translate(F.regexp_replace(text, GAP, " "), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = lower.withColumn("_words", F.when(gate, F.concat(F.lit(" "), F.trim(ascii_lower), F.lit(" ")))).drop("_lower")
    rows = rows.withColumn("n_words", F.regexp_count(text, F.lit(WORD)).cast("long"))

    words, phrases = F.col("_words"), "|".join(BASE.values())
    base = F.lit(f"(?<= )(?:{phrases})(?= )")
    n_base = F.coalesce(F.regexp_count(words, base), F.lit(0)).cast("long")
    first = _spaces(F.element_at(F.split(words, base, F.lit(2)), 1)) - 1
    last = _spaces(F.regexp_extract(words, f"(?s)^(.* )(?:{phrases}) ", 1)) - 1
    table = F.array(*[
        F.struct(F.lit(label).alias("label"), F.lit(keyword).alias("keyword"), F.lit(priority).alias("priority"), F.lit(f"(?<= )(?:{pattern})(?= )").alias("pattern"))
        for label, keyword, priority, pattern in rules()
    ])
    found = F.flatten(
        F.transform(
            F.filter(table, lambda r: F.contains(words, r.keyword)),
            lambda r: F.transform(
                _places(words, r.pattern),
                lambda p: F.struct(p.start.alias("start"), (-p.end).alias("back"), (-r.priority).alias("rank"), r.label.alias("label")),
            ),
        )
    )
    rows = rows.withColumn("_sorted", F.when(words.isNotNull(), F.array_sort(found)))
    rows = rows.withColumn("_found", F.filter("_sorted", lambda x, i: (i == 0) | (x != F.get("_sorted", F.greatest(i - 1, F.lit(0))))))
    rows = rows.withColumns({
        "n_base": n_base,
        "first_word": F.when(n_base > 0, first).cast("long"),
        "last_word": F.when(n_base > 0, last).cast("long"),
        "_base": F.array(*[F.when(F.contains(words, F.lit(f" {p} ")), F.lit(label)) for label, p in sorted(BASE.items())]),
    }).withColumn("_base", F.array_sort(F.array_compact("_base")))
    rows = rows.withColumn("_kept", _unsuppressed(F.col("_found")))
    score = F.lit(0.0)
    for priority, confidence in sorted(CONFIDENCE.items()):
        score = F.when(F.col("_kept.priority") == priority, confidence).otherwise(score)
    return rows.select(
        *[F.col(f"`{c}`") for c in docs.columns], "n_words", "n_base", "first_word", "last_word",
        F.array_join("_base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("_base", F.coalesce(F.col("_kept.labels"), F.array().cast("array<string>"))))), ",").alias("labels"),
        F.greatest(score, F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)).alias("score"),
        F.transform(F.coalesce("_found", F.array().cast("array<struct<start:int,back:int,rank:int,label:string>>")),
                    lambda x: F.struct(x.label.alias("label"), (-x.rank).alias("priority"), x.start.alias("start"), (-x.back).alias("end"))).alias("detections"),
    ).toDF(*names, *ADDED)


def _unsuppressed(found: Column) -> Column:
    """(labels, highest priority) of the places that no other contains, from places sorted by start, falling end and
    falling priority. One sweep keeps, for each priority, the farthest end so far and the start it came from."""
    zero = F.struct(
        *[F.lit(-1).alias(f"{n}{p}") for p in (1, 2, 3) for n in ("end", "start")],
        F.array().cast("array<string>").alias("labels"), F.lit(0).alias("priority"),
    )

    def step(acc: Column, x: Column) -> Column:
        end, own = -x.back, -x.rank
        hidden = F.lit(False)
        for p in (1, 2, 3):
            over = acc[f"end{p}"] >= end
            longer = (acc[f"end{p}"] > end) | ((acc[f"end{p}"] == end) & (acc[f"start{p}"] < x.start))
            hidden = hidden | ((own < p) & over) | ((own == p) & longer)
        far = [(p, (own == p) & (end > acc[f"end{p}"])) for p in (1, 2, 3)]
        fields = [f for p, more in far for f in (F.when(more, end).otherwise(acc[f"end{p}"]).alias(f"end{p}"), F.when(more, x.start).otherwise(acc[f"start{p}"]).alias(f"start{p}"))]
        return F.struct(
            *fields,
            F.when(hidden, acc["labels"]).otherwise(F.array_union(acc["labels"], F.array(x.label))).alias("labels"),
            F.when(hidden, acc["priority"]).otherwise(F.greatest(acc["priority"], own)).alias("priority"),
        )

    return F.aggregate(found, zero, step)


def license_digest(docs: DataFrame) -> DataFrame:
    return scan_licenses(docs.select("doc_id", "text")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
