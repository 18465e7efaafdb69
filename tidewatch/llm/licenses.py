"""License scans: MinHash bands over overlapping text windows, then exact containment.

Texts and license templates become shingles of five words. Templates are put in
classes by size, class c up to 2^c shingles; for it a text is read in windows of
2^(c+1) shingles that begin every 2^c, so any stretch of a template's size lies
in one window whole. A window's MinHash has one permutation and many bins; each
bin is a band, whose value is the least hash that falls into it. Window and
template meet if a band has the same value in both.

Class c has `bins_of(c)` bins, 64 from class 6 on and 4096 / 2^c below. From class
8 on only hashes below 2^(64 - (c - 7)) take part, which leaves some four hashes a
bin. A window of w shingles that holds 0.8 of a template of n has a similarity of
at least 0.8 n / (w + 0.2 n), 0.19 where n is least. So a pair of 64 bands is
missed with a chance of about (1 - 0.19)^64, one in 700,000; below class 6 a shared
shingle is lost where a smaller hash of the window shares its bin, one in 8,192 for
a template of one shingle and less than one in a million from two on, and every
template lies in two windows. What meets is verified: at least `share` of the
template's shingles must be in the window.

A license whose text is nearly another's (AGPL and GPL, two and three clauses) is
told from it by the text: a template gives way where more of a rival is found.

A band's value is one of the window's own hashes, so only windows that hold a hash
which is some template's band value can meet one. These are found first, and the
bands of no other window are formed. All steps are Spark expressions.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm.license_texts import WHOLE

WORDS = 5
SHARE = 0.8
BLOCK = 200_000  # shingles of templates that are broadcast at once

# Fixed texts: short notices by which works name their license.
NOTICES = {
    "mit-line": ("MIT", "Released under the MIT License."),
    "mit-licensed": ("MIT", "This project is licensed under the terms of the MIT license."),
    "apache-2.0-line": ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    "apache-2.0-obtain": ("Apache-2.0", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    "gpl-3.0-line": ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    "gpl-redistribute": (
        "GPL",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ),
    "lgpl-redistribute": (
        "LGPL",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ),
    "bsd-redistribution": (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "mit-permission": (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ),
    "mpl-2.0": ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    "cc-by-nc-4.0-line": ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    "cc-by-4.0-line": ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    "cc-by-sa-4.0-line": ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    "unlicense": ("Unlicense", "This is free and unencumbered software released into the public domain."),
    "agpl-redistribute": (
        "AGPL",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ),
    "epl-2.0": (
        "EPL-2.0",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    ),
    "cc0-1.0": ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide."),
    "cc-by-4.0-long": ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa-4.0-long": ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "cc-by-nc-4.0-long": ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
}
# Fixed text: what stands before a license's identifier in a file.
TAG = "SPDX-License-Identifier:"
# Fixed patterns: an identifier, and identifiers joined to an expression.
IDENTIFIER = "[A-Za-z0-9](?:[A-Za-z0-9.+-]*[A-Za-z0-9+])?"
EXPRESSION = rf"^[ \t]*(\(*{IDENTIFIER}\)*(?:[ \t]+(?:AND|OR|WITH)[ \t]+\(*{IDENTIFIER}\)*)*)"


def template_rows() -> list[tuple[str, str, str]]:
    """Name, license and text of every notice and of every whole license of a page."""
    return [(name, license_name, text) for name, (license_name, text) in NOTICES.items()] + [
        (f"whole-{name}", name, text) for name, text in WHOLE.items()
    ]


def notices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(template_rows(), "template_id string, license string, text string")


def from_files(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of whole license texts as templates, each named after its file."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.txt)?$", 1)
    return spark.read.text(folder, wholetext=True).select(name.alias("template_id"), name.alias("license"), F.col("value").alias("text"))


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1)


def hashes_of(words: Column) -> Column:
    """A hash for each five words in a row."""
    last = F.size(words) - WORDS
    return F.when(
        last >= 0,
        F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WORDS)))),
    ).otherwise(F.array().cast("array<bigint>"))


def shingles_of(words: Column) -> Column:
    """The shingles themselves."""
    last = F.size(words) - WORDS
    return F.when(
        last >= 0,
        F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(words, i + 1, WORDS), " ")),
    ).otherwise(F.array().cast("array<string>"))


def bins_of(size_class: Column) -> Column:
    return F.greatest(F.lit(64), F.call_function("shiftright", F.lit(4096), size_class))


def sketch_of(hashes: Column, size_class: Column) -> Column:
    """The hashes that take part in a class, sorted by bin and size."""
    kept = F.filter(
        hashes,
        lambda x: (size_class <= 7) | (F.call_function("shiftrightunsigned", x, F.lit(71) - size_class) == 0),
    )
    bins = bins_of(size_class)
    return F.array_sort(F.transform(kept, lambda x: F.struct(F.pmod(x, bins).alias("bin"), x.alias("hash"))))


def bands_of(sketch: Column) -> Column:
    """The least hash of every bin, of a column that holds a sorted sketch."""
    least = F.filter(sketch, lambda x, i: (i == 0) | (F.get(sketch, i - 1)["bin"] != x["bin"]))
    return F.array_distinct(F.transform(least, lambda x: x["hash"]))


def computed(df: DataFrame, *columns: Column | str) -> DataFrame:
    """A projection that later steps cannot take apart and compute again for every element."""
    return df.select(F.explode(F.array(F.struct(*columns))).alias("row")).select("row.*")


def prepared(templates: DataFrame, share: float) -> DataFrame:
    """Templates of at least five words: class, distinct shingles, band values and the shingles of rivals.

    A rival is a template of another license that holds `share` of this one's shingles,
    so that its own text would be taken for this one.
    """
    worded = computed(templates, "template_id", "license", words_of(F.coalesce("text", F.lit(""))).alias("words"))
    hashed = computed(
        worded,
        "template_id",
        "license",
        F.array_distinct(shingles_of(F.col("words"))).alias("shingles"),
        F.array_distinct(hashes_of(F.col("words"))).alias("hashes"),
    ).where(F.size("shingles") > 0)
    classed = computed(
        hashed,
        F.xxhash64("template_id", "license", "shingles").alias("template"),
        "template_id",
        "license",
        "shingles",
        "hashes",
        F.ceil(F.log2(F.size("shingles").cast("double"))).cast("int").alias("class"),
    ).dropDuplicates(["template"])
    sketched = computed(
        classed, "template", "template_id", "license", "class", "shingles", sketch_of(F.col("hashes"), F.col("class")).alias("sketch")
    )
    banded = sketched.select("template", "template_id", "license", "class", "shingles", bands_of(F.col("sketch")).alias("bands"))
    held = classed.select("template", "license", F.size("shingles").alias("size"), F.explode("shingles").alias("shingle"))
    other = classed.select(F.col("template").alias("rival"), F.col("license").alias("other"), F.explode("shingles").alias("shingle"))
    pairs = (
        held.join(other, "shingle")
        .where(~F.col("license").eqNullSafe(F.col("other")))
        .groupBy("template", "rival", "size")
        .count()
        .where(F.col("count") / F.col("size") >= share)
    )
    texts = classed.select(F.col("template").alias("rival"), F.col("shingles").alias("text"))
    rivals = pairs.join(texts, "rival").groupBy("template").agg(F.collect_list("text").alias("rivals"))
    none = F.array().cast("array<array<string>>")
    return banded.join(rivals, "template", "left").withColumn("rivals", F.coalesce("rivals", none))


def blocks_of(rows: list) -> list[list]:
    """The templates in blocks of at most `BLOCK` shingles, a larger one by itself."""
    blocks, size = [], BLOCK
    for row in sorted(rows, key=lambda row: (row["class"], row["template"])):
        if size + row["size"] > BLOCK:
            blocks.append([])
            size = 0
        blocks[-1].append(row)
        size += row["size"]
    return blocks


def contained(words: Column, wanted: Column) -> Column:
    return F.size(F.array_intersect(shingles_of(words), wanted)) / F.size(wanted)


def scan(
    docs: DataFrame, templates: DataFrame, key: str = "doc_id", text: str = "text", share: float = SHARE
) -> DataFrame:
    """`doc_id`, `template_id`, `license`, `containment`, `first_word` for each id and template found.

    `containment` is the largest share of a template's distinct shingles in one
    window, `first_word` the place of the first word (from 0) of the first window
    that reaches `share`. A window does not count for a template if more of a rival of
    another license (see `prepared`) lies in the window and one of its length to either
    side; equal shares stay. The templates are a small table of the caller's: their
    band values, 64 at most of each, come to the driver to become part of the plan, and
    the texts are read once for each `BLOCK` shingles of them, which are what is
    broadcast at a time. Null and short texts match nothing, nor do templates below
    five words. Equal templates count once. Repeated rows of an id count together,
    null ids as one. Other columns are ignored.
    """
    known = prepared(templates, share)
    rows = known.select("template", "class", "bands", (F.size("shingles") + F.size(F.flatten("rivals"))).alias("size")).collect()
    schema = docs.select(F.col(key).alias("doc_id")).schema["doc_id"].dataType.simpleString()
    found = docs.sparkSession.createDataFrame(
        [], f"doc_id {schema}, template_id string, license string, containment double, start int"
    )
    texts = computed(docs, F.col(key).alias("doc_id"), words_of(F.coalesce(text, F.lit(""))).alias("words"))
    hashed = computed(texts, "doc_id", "words", hashes_of(F.col("words")).alias("hashes"))
    for block in blocks_of(rows):
        wanted = known.where(F.col("template").isin([row["template"] for row in block]))
        found = found.unionByName(scan_block(hashed, wanted, block, share))
    return found.groupBy("doc_id", "template_id", "license").agg(
        F.max("containment").alias("containment"), F.min("start").alias("first_word")
    )


def scan_block(hashed: DataFrame, known: DataFrame, rows: list, share: float) -> DataFrame:
    """The windows (`doc_id`, `start`) in which a template of one block is found."""
    values: dict[int, set[int]] = {}
    for row in rows:
        values.setdefault(row["class"], set()).update(row["bands"])
    every = sorted(set().union(*values.values()))
    places = F.filter(F.transform("hashes", lambda x, i: F.when(x.isin(every), i)), lambda i: i.isNotNull())
    met = computed(hashed, "doc_id", "words", "hashes", places.alias("places")).where(F.size("places") > 0)

    def windows_of(c: int) -> Column:
        """The windows of a class that hold one of its band values."""
        step = 1 << c
        held = F.filter("places", lambda i: F.get("hashes", i).isin(sorted(values[c])))
        own = F.transform(held, lambda i: (F.floor(i / step) * step).cast("int"))
        starts = F.filter(F.array_distinct(F.concat(own, F.transform(own, lambda s: s - step))), lambda s: s >= 0)
        return F.transform(starts, lambda s: F.struct(F.lit(c).alias("class"), s.alias("start")))

    windows = met.select("doc_id", "words", "hashes", F.explode(F.concat(*map(windows_of, values))).alias("w"))
    size = F.call_function("shiftleft", F.lit(2), F.col("w.class"))
    before = F.least(F.col("w.start"), size)
    cut = computed(
        windows,
        "doc_id",
        F.col("w.class").alias("class"),
        F.col("w.start").alias("start"),
        F.slice("words", F.col("w.start") + 1, size + WORDS - 1).alias("words"),
        F.slice("words", F.col("w.start") - before + 1, before + 2 * size + WORDS - 1).alias("around"),
        sketch_of(F.array_distinct(F.slice("hashes", F.col("w.start") + 1, size)), F.col("w.class")).alias("sketch"),
    )
    banded = computed(cut, "doc_id", "class", "start", "words", "around", bands_of(F.col("sketch")).alias("bands"))
    offered = F.explode(F.filter("bands", lambda x: x.isin(every))).alias("band")
    bands = known.select("class", "template", F.col("bands").alias("own"), F.explode("bands").alias("band"))
    pairs = (
        banded.select("*", offered)
        .join(F.broadcast(bands), ["class", "band"])
        .where(F.array_min(F.array_intersect("bands", "own")) == F.col("band"))
        .drop("class", "band", "bands", "own")
        .join(F.broadcast(known.select("template", "template_id", "license", "shingles", "rivals")), "template")
    )
    verified = computed(
        pairs,
        "doc_id",
        "template_id",
        "license",
        "start",
        "around",
        "rivals",
        contained(F.col("words"), F.col("shingles")).alias("containment"),
    ).where(F.col("containment") >= share)
    beaten = F.exists("rivals", lambda rival: contained(F.col("around"), rival) > F.col("containment"))
    return verified.where(~beaten).select("doc_id", "template_id", "license", "containment", "start")


def scan_tags(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The licenses that documents name by identifier after `SPDX-License-Identifier:`, as rows like `scan`'s.

    `template_id` is "spdx-tag", `license` the identifier as written, `containment` 1.
    Of an expression (`MIT OR Apache-2.0`) each license counts, exceptions after WITH
    do not. `first_word` is the number of words before the first tag that names it,
    three for each tag before. Null texts and tags without an identifier name nothing.
    """
    pieces = computed(docs.where(F.col(text).contains(TAG)), F.col(key).alias("doc_id"), F.split(text, TAG).alias("pieces"))
    counted = computed(pieces, "doc_id", "pieces", F.transform("pieces", lambda p: F.size(words_of(p))).alias("counts"))
    tags = F.transform(
        F.sequence(F.lit(1), F.size("pieces") - 1),
        lambda i: F.struct(
            F.regexp_replace(F.regexp_extract(F.get("pieces", i), EXPRESSION, 1), rf"[ \t]WITH[ \t]+\(*{IDENTIFIER}", "").alias("named"),
            (F.aggregate(F.slice("counts", 1, i), F.lit(0), lambda a, b: a + b) + 3 * (i - 1)).alias("place"),
        ),
    )
    named = counted.select("doc_id", F.explode(tags).alias("tag"))
    split = named.select("doc_id", F.explode(F.regexp_extract_all("tag.named", F.lit(f"({IDENTIFIER})"), 1)).alias("license"), "tag.place")
    return (
        split.where(~F.col("license").isin("AND", "OR"))
        .groupBy("doc_id", "license")
        .agg(F.min("place").alias("first_word"))
        .select("doc_id", F.lit("spdx-tag").alias("template_id"), "license", F.lit(1.0).alias("containment"), "first_word")
    )
