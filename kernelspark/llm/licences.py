"""Licence scan: TF-IDF cosine of headers and licence files to templates, then inheritance by directory.

1. Each file's lines, blocks of neighbouring lines that are mostly template terms, windows of
   each template's number of words anywhere in it, and its whole text are compared with the
   templates as sparse TF-IDF vectors.
   Document frequencies of all words are counted over all files. A word's weight comes from
   its share of the files, up to that of one file in RARE, which all rarer words have: so
   weights don't grow with the number of files, and only words above that share are gathered
   (at most RARE times the mean number of distinct words a file, and twice that near RARE files).
2. A file without a licence of its own inherits that of the licence file in its nearest
   ancestor directory: distinct directories are exploded into ancestors, joined with the
   directories that have a licence, and the deepest match is joined back to the files.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpoint_table, fresh, read, texts

# Short public licence notices, by SPDX identifier.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "This program is licensed under the GNU Affero General Public License, version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
]

_TERM = re.compile(rb"[a-z0-9\x80-\xff]+(?:[.-][a-z0-9\x80-\xff]+)*")
_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)([.-].*)?$"
#: Least cosine of a notice; least part of a line's vector on template terms for it to be looked at.
LEAST, PART = 0.6, 0.5
#: Words in fewer than one file in RARE weigh the same; the largest weight.
RARE = 1_000
CEILING = math.log(RARE) + 1
#: Words that a partition counts before it hands the counts on.
HELD = 300_000


def terms(raw: bytes) -> list[bytes]:
    return _TERM.findall(raw.lower())


class Templates:
    """Templates as unit TF-IDF vectors over their own terms, and the weights of all words."""

    def __init__(self, templates: list[tuple[str, str]], seen: dict[bytes, int], files: int, least: float = LEAST):
        self.names, self.least = [n for n, _ in templates], least
        bags = [Counter(terms(t.encode())) for _, t in templates]
        self.long = [sum(b.values()) for b in bags]
        self.rarest = min(CEILING, math.log(1 + files) + 1)
        self.idf = {w: min(CEILING, math.log((1 + files) / (1 + seen.get(w, 0))) + 1) for w in {*seen, *(w for b in bags for w in b)}}
        self.by_term: dict[bytes, list[tuple[int, float]]] = {}
        for k, bag in enumerate(bags):
            norm = math.sqrt(sum((n * self.idf[w]) ** 2 for w, n in bag.items()))
            for w, n in bag.items():
                self.by_term.setdefault(w, []).append((k, n * self.idf[w] / norm))
        self.code = {w: i for i, w in enumerate(self.by_term, 1)}  # 0: any other word
        self.adds = np.zeros((len(bags), len(self.code) + 1))      # what a word adds to each dot product
        for w, i in self.code.items():
            for k, v in self.by_term[w]:
                self.adds[k, i] = self.idf[w] * v

    def best(self, found: list[bytes]) -> tuple[str | None, float]:
        """Nearest template and its cosine; ties go to the first."""
        dots, norm = np.zeros(len(self.names)), 0.0
        for w, n in Counter(found).items():
            weight = n * self.idf.get(w, self.rarest)
            norm += weight * weight
            for k, v in self.by_term.get(w, ()):
                dots[k] += weight * v
        if not norm or not dots.any():
            return None, 0.0
        k = int(np.argmax(dots))
        return self.names[k], round(float(dots[k] / math.sqrt(norm)), 9)

    def part(self, found: list[bytes]) -> float:
        """How much of the vector's length lies on template terms; no cosine is larger."""
        known = every = 0.0
        for w, n in Counter(found).items():
            weight = (n * self.idf.get(w, self.rarest)) ** 2
            if w in self.by_term:
                known += weight
            else:
                every += weight
        return math.sqrt(known / (known + every)) if known else 0.0

    def window(self, found: list[bytes], best: tuple[str | None, float]) -> tuple[str | None, float]:
        """The better of best and the best cosine, from least on, over the windows that are as long as a template.

        A template whose terms in the text have less than least of its length is left out: no
        window reaches it. So are windows whose cosine would be too small if no word came twice.
        """
        mass = [0.0] * len(self.names)
        for w in self.by_term.keys() & set(found):
            for k, v in self.by_term[w]:
                mass[k] += v * v
        near = [k for k, m in enumerate(mass) if math.sqrt(m) > self.least - 1e-9 and self.long[k] < len(found)]
        if not near:
            return best
        codes = np.array([self.code.get(w, 0) for w in found])
        norms = np.cumsum([0.0, *(self.idf.get(w, self.rarest) ** 2 for w in found)])
        for k in near:
            n, dots = self.long[k], np.concatenate(([0.0], np.cumsum(self.adds[k, codes])))
            bound = (dots[n:] - dots[:-n]) / np.sqrt(norms[n:] - norms[:-n])
            at = np.flatnonzero(bound > max(self.least, best[1]) - 1e-9)
            tried = set()
            for i in at[np.argsort(-bound[at], kind="stable")].tolist():
                if bound[i] <= best[1] + 1e-9:
                    break
                words = tuple(found[i:i + n])
                if words not in tried:
                    tried.add(words)
                    got = self.best(words)
                    if got[1] > best[1]:
                        best = got
        return best

    def header(self, raw: bytes) -> tuple[str | None, float]:
        """Best cosine over the lines that are mostly template terms, the blocks they form, and the windows."""
        best, block, vocabulary, every = (None, 0.0), [], self.by_term.keys(), []
        for line in [*raw.split(b"\n"), b""]:
            found = terms(line)
            every += found
            if not vocabulary.isdisjoint(found) and self.part(found) >= PART:
                block.append(found)
                continue
            for part in [*block, [w for x in block for w in x]] if len(block) > 1 else block:
                got = self.best(part)
                if got[1] > best[1]:
                    best = got
            block = []
        return self.window(every, best)


def frequencies(files: DataFrame, text: str, vocabulary: set[bytes] | None = None) -> tuple[dict[bytes, int], int]:
    """In how many files each word (of the vocabulary, if given) occurs, and the number of files.

    Counts are summed in each partition first. Words that weigh CEILING are left out.
    """
    place = files.columns.index(text)

    def run(batches):
        count, many = Counter(), 0
        for got in batches:
            for raw in texts(got.column(place)):
                found = set(terms(raw))
                count.update(found if vocabulary is None else found & vocabulary)
                many += 1
                if len(count) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], ["term", "n"])
                    count = Counter()
        yield pa.RecordBatch.from_arrays([pa.array([None, *count], pa.binary()), pa.array([many, *count.values()], pa.int64())], ["term", "n"])

    found = files.mapInArrow(run, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = checkpoint_table(found, files.sparkSession, "licence-words")
    many = found.where(F.col("term").isNull()).agg(F.sum("n")).first()[0] or 0
    common = found.where(F.col("term").isNotNull() & ((F.col("n") + 1) * RARE > many + 1)).collect()  # bounded: see above
    return {bytes(r.term): r.n for r in common}, many


def scan(files: DataFrame, text: str = "text", path: str = "path", templates: list[tuple[str, str]] | None = None, least: float = LEAST) -> DataFrame:
    """files without the text, with own_licence, own_score, licence, licence_from and licence_dir.

    A licence file has a licence's file name (or, whatever its name, a whole text that is a
    notice) and lends its licence to its directory and all below; of several in a directory
    the best score counts, then the first name. licence_from is 'file', 'directory' or null.
    A null text has no licence, a null path no directory, so nothing to inherit. Repeated
    rows stay; an empty table gives an empty result. Clashing columns raise ValueError.
    """
    made = ["own_licence", "own_score", "licence", "licence_from", "licence_dir"]
    if clash := set(made) & {c.lower() for c in files.columns}:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    spark, keep = files.sparkSession, [c for c in files.columns if c != text]
    known = templates or TEMPLATES
    sent = spark.sparkContext.broadcast(Templates(known, *frequencies(files.select(text), text), least))
    whole, folder, depth, lent = (fresh([*files.columns, *made], f"__{x}") for x in ("whole", "folder", "depth", "lent"))
    at, place = [files.columns.index(c) for c in keep], files.columns.index(text)

    def run(batches):
        model = sent.value
        for got in batches:
            rows = []
            for raw in texts(got.column(place)):
                name, score = model.header(raw)
                found = model.best(terms(raw)) if score >= least else (None, 0.0)
                if found[1] >= score > 0:
                    name, score = found
                rows.append((name if score >= least else None, score, found[1] >= least))
            yield pa.RecordBatch.from_arrays([got.column(i) for i in at] + [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.bool_())], [*keep, "own_licence", "own_score", whole])

    extra = [T.StructField("own_licence", T.StringType()), T.StructField("own_score", T.DoubleType()), T.StructField(whole, T.BooleanType())]
    scored = files.mapInArrow(run, T.StructType([files.schema[c] for c in keep] + extra))
    scored = checkpoint_table(scored.withColumn(folder, _folder(F.col(path))), spark, "licence-files")
    lends = F.col("own_licence").isNotNull() & (F.col(whole) | F.regexp_extract(F.col(path), "[^/]*$", 0).rlike(_FILE))
    lenders = scored.where(lends & F.col(folder).isNotNull()).groupBy(folder).agg(F.min(F.struct((-F.col("own_score")).alias("s"), F.col("own_licence").alias("l")))["l"].alias(lent))
    above = scored.select(folder).where(F.col(folder).isNotNull()).distinct().withColumn("above", F.explode(_ancestors(F.col(folder))))
    lenders = lenders.select(F.col(folder).alias("above"), F.col(lent).alias("lent"), F.length(folder).alias("deep"))
    nearest = above.join(lenders, "above").groupBy(folder).agg(F.max(F.struct("deep", "above", "lent")).alias(depth))
    joined = scored.join(nearest, folder, "left")
    own = F.col("own_licence").isNotNull()
    return joined.select(*keep, "own_licence", "own_score", F.coalesce("own_licence", f"{depth}.lent").alias("licence"),
                         F.when(own, "file").when(F.col(depth).isNotNull(), "directory").alias("licence_from"),
                         F.when(~own, F.col(f"{depth}.above")).alias("licence_dir"))


def _folder(path: Column) -> Column:
    """Directory of a path, without outer slashes; '' at the top."""
    return F.array_join(F.filter(F.split(F.regexp_replace(path, "[^/]*$", ""), "/"), lambda p: p != ""), "/")


def _ancestors(folder: Column) -> Column:
    """The directory and all above it, the top included."""
    parts = F.filter(F.split(folder, "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def document_path() -> Column:
    """Path of a document for the query: the documents have none, so source and id give one.

    source/shelf/part/id.txt: a part has 100 consecutive ids, a shelf 100 parts, so folders
    grow with the data and none has more than 100 ids of a source.
    """
    part = F.floor(F.col("doc_id") / 100)
    return F.concat(F.coalesce("source", F.lit("none")), F.lit("/shelf"), F.floor(part / 100).cast("string"), F.lit("/part"), part.cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))


def op4_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", document_path().alias("path"), "text")
    found = scan(docs)
    return found.select("doc_id", "path", "own_licence", F.round("own_score", 6).alias("own_score"), "licence", "licence_from", "licence_dir")
