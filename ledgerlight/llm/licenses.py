"""Operator 2: license scans with ordered signature rules, in DataFrame functions only.

Every rule has a keyword that all its matches contain, a priority, a label and a regex. A text that has no gate word costs one
search; every match of a rule or base phrase holds a gate word, whatever stands between the words. In the
others each rule whose keyword is there gives the places of all its matches; a match that lies within
one of better priority (or of the same and longer) is suppressed. All of it is one narrow projection: no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the result: phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: label, keyword, regex of the name, for texts of lower-case words joined by single spaces. Specific names first.
NAMES = [
    ("agpl-3.0", "affero", r"(?:gnu )?affero general public license(?: agpl)?(?: version| v)? ?3(?: 0)?(?: or(?: \(?at your option\)?)? (?:any )?later(?: version)?)?"),
    ("agpl", "affero", r"(?:gnu )?affero (?:general public )?license"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public license(?: lgpl)?(?: version| v)? ?2 1"),
    ("lgpl-3.0", "lesser", r"(?:gnu )?lesser general public license(?: lgpl)?(?: version| v)? ?3(?: 0)?"),
    ("lgpl-2.0", "library", r"(?:gnu )?library general public license(?: version| v)? ?2(?: 0)?"),
    ("agpl-3.0", "agpl", r"(?:gnu )?agpl ?v?3(?: 0)?(?: only| or later)?"),
    ("agpl", "agpl", r"(?:gnu )?agpl"),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl ?v?2 1(?: only| or later)?"),
    ("lgpl-2.0", "lgpl", r"(?:gnu )?lgpl ?v?2 0(?: only| or later)?"),
    ("lgpl-3.0", "lgpl", r"(?:gnu )?lgpl ?v?3(?: 0)?(?: only| or later)?"),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl ?v?3(?: 0)?(?: only| or later)?"),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl ?v?2(?: 0)?(?: only| or later)?"),
    ("gpl-1.0", "gpl", r"(?:gnu )?gpl ?v?1(?: 0)?(?: only| or later)?"),
    ("apache-2.0", "apache", r"apache 2 0(?! [0-9])"),
    ("mpl-2.0", "mpl", r"mpl 2 0"),
    ("mpl-1.1", "mpl", r"mpl 1 1"),
    ("epl-2.0", "epl", r"epl 2 0"),
    ("epl-1.0", "epl", r"epl 1 0"),
    ("eupl-1.2", "eupl", r"eupl 1 2"),
    ("bsl-1.0", "bsl", r"bsl 1 0"),
    ("ofl-1.1", "ofl", r"ofl 1 1"),
    ("artistic-2.0", "artistic", r"artistic 2 0"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl"),
    ("gpl-3.0", "general", r"(?:gnu )?general public license(?: gpl)?(?: version| v)? ?3(?: 0)?"),
    ("gpl-2.0", "general", r"(?:gnu )?general public license(?: gpl)?(?: version| v)? ?2(?: 0)?"),
    ("gpl-1.0", "general", r"(?:gnu )?general public license(?: gpl)?(?: version| v)? ?1(?: 0)?"),
    ("gpl", "gpl", r"(?:gnu )?gpl(?: ?v?[123](?: 0)?)?"),
    ("apache-2.0", "apache", r"apache(?: software)? license(?: version| v)? ?2(?: 0)?"),
    ("apache-1.1", "apache", r"apache(?: software)? license(?: version| v)? ?1 1"),
    ("apache-1.0", "apache", r"apache(?: software)? license(?: version| v)? ?1 0"),
    ("mit-0", "mit", r"mit (?:0|no attribution)(?: license)?"),
    ("mit", "mit", r"(?:the )?mit(?: mit)? license"),
    ("mit", "expat", r"(?:the )?expat(?: mit)? license"),
    ("mit", "x11", r"(?:the )?x11(?: mit)? license"),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|freebsd|bsd 2 clause|2 clause bsd)(?: license)?"),
    ("bsd-3-clause", "bsd", r"(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd)(?: license)?"),
    ("bsd-4-clause", "bsd", r"(?:original bsd|old bsd|bsd 4 clause|4 clause bsd)(?: license)?"),
    ("bsd-0-clause", "bsd", r"(?:zero clause bsd|bsd zero clause|0bsd)(?: license)?"),
    ("bsd", "bsd", r"bsd(?: style| type)? license"),
    ("mpl-2.0", "mozilla", r"mozilla public license(?: mpl)?(?: version| v)? ?2(?: 0)?"),
    ("mpl-1.1", "mozilla", r"mozilla public license(?: mpl)?(?: version| v)? ?1 1"),
    ("mpl", "mozilla", r"mozilla public license"),
    ("epl-2.0", "eclipse", r"eclipse public license(?: epl)?(?: version| v)? ?2(?: 0)?"),
    ("epl-1.0", "eclipse", r"eclipse public license(?: epl)?(?: version| v)? ?1(?: 0)?"),
    ("cddl-1.0", "development", r"common development and distribution license(?: version| v)? ?1(?: 0)?"),
    ("cddl-1.0", "cddl", r"cddl(?: version| v)? ?1(?: 0)?"),
    ("cpl-1.0", "common", r"common public license(?: version| v)? ?1(?: 0)?"),
    ("eupl-1.2", "european", r"european union public license(?: eupl)?(?: version| v)? ?1 2"),
    ("isc", "isc", r"isc license"),
    ("zlib", "zlib", r"zlib(?: libpng)? license"),
    ("bsl-1.0", "boost", r"boost software license(?: version| v)? ?1(?: 0)?"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("artistic-2.0", "artistic", r"artistic license(?: version| v)? ?2(?: 0)?"),
    ("artistic", "artistic", r"artistic license"),
    ("python-2.0", "python", r"python(?: software foundation)? license(?: version| v)? ?2?"),
    ("postgresql", "postgresql", r"postgresql license"),
    ("openssl", "openssl", r"openssl license"),
    ("ofl-1.1", "sil", r"sil open font license(?: version| v)? ?1 1"),
    ("ms-pl", "microsoft", r"microsoft public license"),
    ("ncsa", "ncsa", r"(?:university of illinois )?ncsa(?: open source)? license"),
    ("odbl-1.0", "database", r"open database license(?: version| v)? ?1?(?: 0)?"),
    ("odbl-1.0", "odbl", r"odbl(?: version| v)? ?1?(?: 0)?"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-nd-4.0", "cc", r"cc by nc nd(?: 4 0)?"),
    ("cc-by-nc-sa-4.0", "cc", r"cc by nc sa(?: 4 0)?"),
    ("cc-by-nc-4.0", "cc", r"cc by nc 4 0"),
    ("cc-by-nc", "cc", r"cc by nc"),
    ("cc-by-nd-4.0", "cc", r"cc by nd(?: 4 0)?"),
    ("cc-by-sa-4.0", "cc", r"cc by sa(?: 4 0)?"),
    ("cc-by-4.0", "cc", r"cc by(?: 4 0)?"),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial(?: 4 0| 3 0)?(?: international)?(?: license)?"),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike(?: 4 0| 3 0)?(?: international)?(?: license)?"),
    ("cc-by", "creative", r"creative commons attribution(?: 4 0| 3 0)?(?: international)?(?: license)?"),
    ("public-domain", "domain", r"(?:in(?:to)? the|dedicated to the) public domain"),
    ("proprietary", "rights", r"all rights reserved"),
]
#: SPDX identifiers that are common words or short: they count only after the SPDX mark, the first ones also where something is licensed under them.
IDS = "mit isc zlib ncsa|apache-1.0 apache-1.1 artistic-1.0 afl-3.0 apsl-2.0 beerware blueoak-1.0.0 busl-1.1 cddl-1.1 cecill-2.1 cpl-1.0 curl ecl-2.0 elastic-2.0 eupl-1.1 fsfap ftl gfdl-1.3 hpnd icu ijg ipl-1.0 json libpng-2.0 lppl-1.3c ms-pl ms-rl mulanpsl-2.0 ofl-1.0 openssl osl-3.0 php-3.01 postgresql psf-2.0 python-2.0 ruby sleepycat sspl-1.0 tcl unicode-dfs-2016 upl-1.0 vim w3c x11 zpl-2.1".split("|")
#: label, keyword, regex of a characteristic sentence of a license's own text or notice.
SENTENCES = [
    ("mit", "hereby granted", r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("ncsa", "deal with the software", r"to deal with the software without restriction"),
    ("bsl-1.0", "hereby granted", r"permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation"),
    ("isc", "hereby granted", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted"),
    ("postgresql", "hereby granted", r"for any purpose without fee and without a written agreement is hereby granted"),
    ("bsd-4-clause", "advertising materials", r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("bsd-3-clause", "contributors may be used", r"neither the names? of (?:[0-9a-z]+ ){1,12}nor the names of (?:its|their|any|other)(?: other)? contributors may be used to endorse or promote products"),
    ("bsd", "binary forms", r"redistribution and use in source and binary forms(?: with or without modification)? are permitted"),
    ("zlib", "altered source", r"altered source versions must be plainly marked as such"),
    ("unlicense", "public domain", r"this is free and unencumbered software released into the public domain"),
    ("cc0-1.0", "affirmer", r"affirmer hereby overtly fully permanently irrevocably and unconditionally waives"),
    ("beerware", "retain this notice", r"as long as you retain this notice you can do whatever you want with this stuff"),
    ("wtfpl", "licen", r"copies of this license document and changing it is allowed as long as the name is changed"),
    ("apache-2.0", "licenses license 2", r"you may obtain a copy of the license at https? www apache org licenses license 2 0"),
    ("apache-1.1", "apache software foundation", r"this product includes software developed by the apache software foundation"),
    ("openssl", "openssl project", r"this product includes software developed by the openssl project"),
    ("gpl-3.0", "license", r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("agpl-3.0", "license", r"the gnu affero general public license is a free copyleft license for software and other kinds of works"),
    ("lgpl-3.0", "license", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3"),
    ("gpl-3.0", "license", r"under the terms of the gnu general public license as published by the free software foundation either version 3"),
    ("gpl-2.0", "license", r"under the terms of the gnu general public license as published by the free software foundation either version 2"),
    ("lgpl-2.1", "license", r"under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1"),
    ("agpl-3.0", "license", r"under the terms of the gnu affero general public license as published by the free software foundation either version 3"),
    ("mpl-2.0", "license", r"this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cddl-1.0", "license", r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("epl", "license", r"the accompanying program is provided under the terms of this eclipse public license"),
    ("ofl-1.1", "licensed fonts", r"the ofl allows the licensed fonts to be used studied modified and redistributed freely"),
    ("artistic-2.0", "license", r"this license establishes the terms under which a given free software package may be copied modified distributed"),
    ("python-2.0", "license", r"this license agreement is between the python software foundation psf"),
]
#: Frames around a name: regex before, regex after, confidence. The frames with more words have the better priority.
FRAMES = [
    (r"(?:released|licensed|distributed|published|made available|provided) under (?:the )?(?:terms of )?(?:the )?", "", 0.95),
    (r"(?:subject to|governed by|under) (?:the )?(?:terms of )?(?:the )?", "", 0.9),
    (r"spdx license identifier ", "", 1.0),
    ("", "", 0.8),
]
_GAP = r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"  # all that is no word
GATE = r"(?i)" + "licen[cs]e|spdx|gpl|cc0|bsd|wtfpl|cddl|odbl|public domain|rights reserved|creative commons|cc by|mit (?:0|no)|(?:apache|[em]pl|eupl|bsl|ofl|artistic) [12]|under (?:the )?(?:terms of )?(?:the )?(?:mit|isc|zlib|ncsa)|hereby granted|deal with the software|advertising materials|contributors may be used|binary forms|altered source|affirmer|retain this notice|apache software foundation|openssl project".replace(" ", _GAP)
WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"


def rules() -> list[tuple[int, str, str, str, float]]:
    """(priority, label, keyword, regex, confidence): sentences, each name in each frame, and SPDX identifiers, the first ones best."""
    out = [(i - 1000, label, key, f"(?<= ){rx}(?= )", 0.95) for i, (label, key, rx) in enumerate(SENTENCES)]
    for f, (before, after, sure) in enumerate(FRAMES):
        out += [(f * 1000 + i, label, key, f"(?<= ){before}{name}{after}(?= )", sure) for i, (label, key, name) in enumerate(NAMES)]
    mark = FRAMES[2][0]
    for i, label in enumerate(" ".join(IDS).split()):
        words = label.replace("-", " ").replace(".", " ")
        out.append((4000 + i, label, words, f"(?<= ){mark}{words}(?= )", 1.0))
        out.append((5000 + i, label, words, f"(?<= ){mark}(?:[0-9a-z]+ ){{1,6}}?(?:or|and) {words}(?= )", 1.0))  # a later part of an expression
        if label in IDS[0].split():
            out.append((6000 + i, label, words, f"(?<= ){FRAMES[0][0]}{words}(?= )", FRAMES[0][2]))
    return out


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Matches and hits that are worked on together: work on n of them grows as n times CHUNK and as n * n / CHUNK cheap steps.
CHUNK = 256


def _chunks(x: Column) -> Column:
    """An array in pieces of CHUNK."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(x) - 1) / CHUNK)).cast("int")), lambda k: F.slice(x, k * CHUNK + 1, CHUNK))


def _places(text: Column, rule: Column) -> Column:
    """start and end of all matches of a rule, from the pieces between them."""
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["p"])
        end = start + F.length(x["m"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end")))).alias("out"))

    def piece(acc: Column, x: Column) -> Column:
        own = F.aggregate(x, F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return _let(own, lambda o: F.struct(o["at"].alias("at"), F.concat(acc["out"], F.array(o["out"])).alias("out")))

    def all_places(found: Column) -> Column:
        pieces = F.split(text, rule["regex"], -1)
        pairs = F.zip_with(F.slice(pieces, 1, F.size(found)), found, lambda p, m: F.struct(p.alias("p"), m.alias("m")))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<struct<start:int,end:int>>>").alias("out"))
        whole = _let(pairs, lambda x: F.aggregate(_chunks(x), zero, piece, lambda acc: F.flatten(acc["out"])))
        return F.when(F.size(found) > 0, whole).otherwise(none)

    return _let(F.regexp_extract_all(text, rule["regex"], F.lit(0)), all_places)


def _detections(text: Column) -> Column:
    table = F.array(*[F.struct(F.lit(p).alias("priority"), F.lit(lab).alias("label"), F.lit(key).alias("key"), F.lit(rx).alias("regex"), F.lit(c).alias("sure")) for p, lab, key, rx, c in rules()])
    fit = F.filter(table, lambda r: F.contains(text, r["key"]))
    # by start, so that what contains a hit stands before it or begins with it
    hits = F.flatten(F.transform(fit, lambda r: F.transform(_places(text, r), lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"), r["priority"].alias("priority"), r["label"].alias("label"), r["sure"].alias("sure")))))

    def kept(all_hits: Column) -> Column:
        def own(chunk: Column) -> Column:
            """Hits of a chunk that none of those suppresses that reach into it."""
            first, last = F.get(chunk, F.lit(0))["start"], F.element_at(chunk, -1)["start"]
            near = F.filter(all_hits, lambda o: (o["end"] > first) & (o["start"] <= last))

            def free(d: Column, others: Column) -> Column:
                return ~F.exists(others, lambda o: (o["start"] <= d["start"]) & (o["end"] >= d["end"]) & ((o["end"] - o["start"] > d["end"] - d["start"]) | (o["priority"] < d["priority"])) & (o["priority"] <= d["priority"]))

            return _let(near, lambda others: F.filter(chunk, lambda d: free(d, others)))

        return F.when(F.size(all_hits) > 0, F.flatten(F.transform(_chunks(all_hits), own))).otherwise(all_hits)

    return _let(F.array_sort(hits), kept)


def license_scan(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each row of (doc_id, text).

    Words are runs of A-Z (lower-cased), digits and non-ASCII characters. n_base counts the places where the words of a base phrase stand together;
    first_word and last_word are the smallest and largest of them, null without any. labels are the base labels and those of
    the rules' unsuppressed matches; score is the best confidence among them (0.9 for a base phrase), 0 without any. Null texts count
    as empty; rows without doc_id are left out; repeated rows each give a row; other columns are ignored.
    """
    raw = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lower = F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))

    def base(w: Column) -> Column:
        def places(phrase: str, label: str) -> Column:
            own = phrase.split(" ")
            same = lambda i: _all(F.get(w, i + j) == F.lit(x) for j, x in enumerate(own))
            at = F.filter(F.sequence(F.lit(0), F.size(w) - 1), same)
            return F.transform(at, lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))

        return F.when(F.size(w) > 0, F.concat(*[places(p, lab) for p, lab in BASE.items()])).otherwise(F.array().cast("array<struct<at:bigint,label:string>>"))

    def scan(w: Column) -> Column:
        text = F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
        return F.struct(base(w).alias("base"), _let(text, _detections).alias("found"))

    shape = "struct<base:array<struct<at:bigint,label:string>>,found:array<struct<start:int,end:int,priority:int,label:string,sure:double>>>"
    none = F.struct(F.array().alias("base"), F.array().alias("found")).cast(shape)
    scanned = F.when(raw.rlike(GATE), _let(words, scan).cast(shape)).otherwise(none)
    rows = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_count(raw, F.lit(WORD)).cast("long").alias("n_words"), scanned.alias("s"))
    at, base_labels = F.col("s.base.at"), F.array_distinct(F.col("s.base.label"))
    labels = F.array_distinct(F.concat(F.col("s.base.label"), F.col("s.found.label")))
    sure = F.concat(F.col("s.found.sure"), F.transform(at, lambda _: F.lit(0.9)))
    return rows.select(
        "doc_id",
        "n_words",
        F.size(at).cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        F.array_join(F.array_sort(base_labels), ",").alias("base_labels"),
        F.array_join(F.array_sort(labels), ",").alias("labels"),
        F.coalesce(F.array_max(sure), F.lit(0.0)).alias("score"),
    )


def _all(conditions) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out & c
    return out
