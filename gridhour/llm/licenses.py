"""License scans: notices by TF-IDF cosine, then inheritance along directories.

A text is compared with templates by windows of a template's length, wherever one of the
template's rarest terms stands, so neither what surrounds a notice nor line breaks inside it count.
Terms weigh by the share of the corpus' documents that have them, so the words that all prose
shares count little, and the same notice gets the same score however many documents there are. A
document without a notice of its own takes the licence of the nearest directory above it that holds
a licence file, found by joining paths.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridhour.llm.common import query, stored, table

# Usual wordings of license notices, and the main paragraphs of licence texts.
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
        "Apache License Version 2.0, January 2004 TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
        "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    ],
    "GPL-2.0": [
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
        "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    ],
    "LGPL-2.1": ["under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version"],
    "AGPL-3.0": ["under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "CC0 1.0 Universal Public Domain Dedication"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "Creative Commons Attribution-NonCommercial 4.0 International License"],
    "proprietary": ["All rights reserved."],
}
LEAST = 0.75
#: A term weighs as if at least this share of all documents had it, whether a template has it or not.
LEAST_SHARE = 1e-4
#: Windows start at a rare term of the template, and so many terms before and after where it would have to stand.
RARE, SLACK = 2, 1
TERM = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
FILE = r"(?i)^(licen[cs]e|copying)(\.[a-z]+)?$"


def terms(text: str) -> list[str]:
    return TERM.findall(text.lower())


class Scanner:
    """Cosines of sparse tf-idf vectors of windows to the templates.

    ``1 + ln(1 / share)`` is a term's weight, from the share of documents that have it. A term that
    no template has is taken for one that hardly any document has.
    """

    def __init__(self, df: dict[str, int], documents: int, templates: dict[str, list[str]]):
        self.other = 1.0 - math.log(LEAST_SHARE)
        self.weight = {t: 1.0 - math.log(max(n / max(documents, 1), LEAST_SHARE)) for t, n in df.items()}
        self.rows = []
        for name, wordings in sorted(templates.items()):
            for wording in wordings:
                words = terms(wording)
                vector = {t: n * self.of(t) for t, n in Counter(words).items()}
                rare = sorted(vector, key=lambda t: (-self.of(t), t))[:RARE]
                starts = {t: words.index(t) for t in rare}
                self.rows.append((name, vector, math.sqrt(sum(v * v for v in vector.values())), len(words), starts))
        self.anchors = {t for *_, starts in self.rows for t in starts}

    def of(self, term: str) -> float:
        return self.weight.get(term, self.other)

    def cosine(self, words: list[str], row: tuple) -> float:
        _, vector, norm, _, _ = row
        inside = {t: n * self.of(t) for t, n in Counter(words).items()}
        whole = math.sqrt(sum(v * v for v in inside.values()))
        return min(1.0, sum(v * vector.get(t, 0.0) for t, v in inside.items()) / norm / whole) if whole else 0.0

    def find(self, text: str | None) -> list[tuple[float, str]]:
        """Score and name of every notice, best first: of windows that overlap the best one counts."""
        lower = (text or "").lower()
        if not any(a in lower for a in self.anchors):
            return []
        words = TERM.findall(lower)
        places: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            if w in self.anchors:
                places.setdefault(w, []).append(i)
        hits = set()
        for row in self.rows:
            name, _, _, size, starts = row
            for at in {max(0, p - offset + shift) for t, offset in starts.items() for p in places.get(t, ()) for shift in range(-SLACK, SLACK + 1)}:
                score = self.cosine(words[at : at + size], row)
                if score >= LEAST:
                    hits.add((-round(score, 12), name, at, min(at + size, len(words))))
        found, taken = [], []
        for score, name, start, end in sorted(hits):
            if all(end <= s or start >= e for s, e in taken):
                taken.append((start, end))
                found.append((-score, name))
        return found


def term_spread(docs: DataFrame, text: str, templates: dict[str, list[str]]) -> tuple[dict[str, int], int]:
    """In how many documents each template term stands, over all documents.

    One row for each template term reaches the driver.
    """
    known = {t for wordings in templates.values() for w in wordings for t in terms(w)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        rows = 0
        for b in batches:
            for t in b["text"].to_pylist():
                found.update(known.intersection(terms(t or "")))
            rows += len(b)
        names = ["", *found]
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([rows, *found.values()], pa.int64())], names=["term", "n"])

    summed = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    df = {r["term"]: r["n"] for r in summed.collect()}
    return df, df.pop("", 0)


def notices(docs: DataFrame, path: Column, *, doc_id: str = "doc_id", text: str = "text", templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """``row, doc_id, path, n_notices, own_license, own_score`` for each row of ``docs``."""
    df, n = term_spread(docs, text, templates)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), path.cast("string").alias("path"), F.col(text).cast("string").alias("text"))
    schema = T.StructType(
        [*rows.schema.fields[:3], T.StructField("n_notices", T.LongType()), T.StructField("own_license", T.StringType()), T.StructField("own_score", T.DoubleType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(df, n, templates)
        for b in batches:
            out = []
            for t in b["text"].to_pylist():
                found = scanner.find(t)
                score, name = found[0] if found else (0.0, None)
                out.append((len(found), name, score))
            columns = [pa.array([o[i] for o in out], k) for i, k in enumerate((pa.int64(), pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([b["row"], b["doc_id"], b["path"], *columns], names=schema.names)

    return rows.mapInArrow(run, schema)


def _folder(path: Column) -> Column:
    """The directory of a path; that of a bare name is the empty path, above all others."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(docs: DataFrame, path: Column, *, doc_id: str = "doc_id", text: str = "text", templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """``doc_id, path, n_notices, own_license, own_score, license, license_folder`` for each row.

    ``license`` is the document's own, or else that of the nearest folder above, named in
    ``license_folder``. Of several licence files in a folder the best score counts, then the
    first name. A null text has no notice; a null path has no folder and inherits nothing. Texts of
    any length are read whole; of equal scores the first licence by name counts.
    Inheritance is found once for each folder, so a folder with very many documents costs no
    more than another. Repeated rows count each; no rows give no rows.
    """
    found = stored(notices(docs, path, doc_id=doc_id, text=text, templates=templates), "license-notices")
    found = found.withColumn("folder", _folder(F.col("path")))
    files = found.where("own_license is not null").where(F.regexp_extract("path", r"[^/]*$", 0).rlike(FILE))
    held = files.groupBy("folder").agg(F.min(F.struct((-F.col("own_score")).alias("s"), F.col("own_license").alias("l"))).alias("best"))
    held = stored(held.select(F.col("folder").alias("above"), F.col("best.l").alias("given")), "license-folders")
    depth = F.when(F.col("folder") == "", 0).otherwise(F.size(F.split("folder", "/")))
    folders = found.where("folder is not null").select("folder").distinct().withColumn("d", F.explode(F.sequence(F.lit(0), depth)))
    folders = folders.withColumn("above", F.array_join(F.slice(F.split("folder", "/"), 1, F.col("d")), "/"))
    nearest = folders.join(held, "above").groupBy("folder").agg(F.max(F.struct("d", "above", "given")).alias("near"))
    nearest = stored(nearest.select("folder", F.col("near.above").alias("near_folder"), F.col("near.given").alias("near_license")), "license-nearest")
    joined = found.join(nearest, "folder", "left")
    own = F.col("own_license").isNotNull()
    return joined.select(
        "doc_id", "path", "n_notices", "own_license", "own_score",
        F.coalesce("own_license", "near_license").alias("license"), F.when(~own, F.col("near_folder")).alias("license_folder"),
    )


def id_path(doc_id: Column, source: Column) -> Column:
    """Made-up paths for tables without any: source, then folders of 1000, 100 and 10 ids; the first
    document of each folder is its licence file. A null id has no path."""
    n = doc_id.cast("long")
    a, b, c = F.floor(n / 1000), F.floor(n / 100) % 10, F.floor(n / 10) % 10
    top = F.concat_ws("/", F.coalesce(source, F.lit("unknown")), F.concat(F.lit("a"), a))
    return (
        F.when(n % 1000 == 0, F.concat(top, F.lit("/LICENSE")))
        .when(n % 100 == 0, F.concat(top, F.lit("/b"), b, F.lit("/LICENSE")))
        .when(n % 10 == 0, F.concat(top, F.lit("/b"), b, F.lit("/c"), c, F.lit("/LICENSE")))
        .otherwise(F.concat(top, F.lit("/b"), b, F.lit("/c"), c, F.lit("/"), n.cast("string"), F.lit(".txt")))
    )


@query("op5_license_scan")
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan(docs, id_path(F.col("doc_id"), F.col("source")))
    return found.withColumn("own_score", F.round("own_score", 6))
