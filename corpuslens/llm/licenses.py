"""License scans by a trained paragraph classifier.

A paragraph is a line; a longer one than WINDOW words is read in windows that overlap by half. Lines that no blank line (one without
words) parts are also read together, in windows of WINDOW words across their breaks, each STEP words on, so that a notice
wrapped over lines is seen whole; what they find counts where no line's own match of that family stands, and
replaces matches of family unknown in that place. Words and word pairs of a
paragraph, hashed, go into a multinomial logistic regression whose classes are license families, ``unknown`` (talk of a
license of no known family) and ``none``. It is trained in numpy, in a task of an executor, on variations of the templates below, on
made-up license names, and on paragraphs of a bounded sample of documents. Its probabilities are calibrated by a temperature: a first
model learns from all but one template of each family, and the temperature is the one that fits its answers to variations
of the templates (and of a fifth of the paragraphs) that it never saw.

The classifier decides. A paragraph that is likelier none than all else has no license; else the likeliest family is predicted. The
comparison with that family's templates confirms it: at least MIN_CONTAINED of the words and pairs of one of them stand in the paragraph.
A prediction that isn't confirmed, and the class unknown, count as unknown where the likeliest class is ODDS times as likely as none, or more.

Null texts count as empty and have no paragraphs; a null doc_id stays null; rows that repeat are scanned each; columns
beside doc_id and text are ignored; an empty table gives no rows; the highest probability among a document's families
decides ties, then the name. Scanning is map-side and reads whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.llm import arrays
from corpuslens.llm.scratch import bounded

WINDOW, STEP, MIN_CONTAINED, ODDS = 40, 10, 0.8, 2.5
#: Documents whose paragraphs serve as examples without a license, at most (the lowest hashes of doc_id), and paragraphs, in all and of one.
SAMPLE_DOCS, SAMPLE_PARAGRAPHS, OF_ONE = 400, 1500, 50
#: Characters of such a paragraph, at most: some windows. A paragraph that is scanned is never cut.
SAMPLE_CHARS = 2000
#: Windows whose scores are summed at once.
SUMMED = 1 << 14
BUCKET_BITS, VARIATIONS, EPOCHS = 15, 30, 60

#: Usual notices of license families.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Released under the Apache License 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "Licensed under the GNU GPL v3.",
        "Licensed under the GNU General Public License.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Released under the GNU General Public License version 2 or any later version.",
    ),
    "LGPL": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "Licensed under the GNU Lesser General Public License.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "Released under the LGPL v3.",
    ),
    "AGPL": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "Licensed under the GNU Affero General Public License.",
        "Released under the AGPL v3.",
    ),
    "BSD": (
        "Licensed under the BSD 3-Clause License.",
        "Released under the BSD license.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
    ),
    "CC-BY": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "Licensed under CC BY 4.0.",
    ),
    "CC-BY-SA": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Licensed under CC BY-SA 4.0.",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.",
    ),
    "Public-Domain": (
        "This is free and unencumbered software released into the public domain.",
        "To the extent possible under law, the author has waived all copyright under CC0 1.0 Universal.",
        "Dedicated to the public domain.",
    ),
    "All-Rights-Reserved": (
        "All rights reserved.",
        "Copyright by the author. All rights reserved.",
        "No part of this publication may be reproduced without the prior written permission of the publisher.",
    ),
}
#: License talk without a family; * stands for a made-up name.
UNFAMILIAR = (
    "Licensed under the * License.",
    "Released under the terms of the * Public License, version 1.1.",
    "This work is licensed under the * license agreement.",
    "Use of this document is governed by the * license.",
    "Distributed under the * Open License 2.0.",
    "Licensed to * under a license agreement.",
)
#: Paragraphs of documents that match aren't taken as examples without a license.
TALK = re.compile(r"licen[cs]|copyright|rights reserved|public domain|redistribut|permission|copyleft", re.IGNORECASE)
FAMILIES = tuple(TEMPLATES)
CLASSES = (*FAMILIES, "unknown", "none")

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def paragraphs(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words; the first and the last word (one more) of all paragraphs and windows."""
    starts, ends = arrays.spans(_WORD, low, offsets)
    a, b = arrays.spans(arrays.IN_LINE, low, offsets)
    first, last = np.searchsorted(starts, a), np.searchsorted(starts, b)
    first, last = first[last > first], last[last > first]
    pieces = np.maximum(1, -(-(last - first - WINDOW) // (WINDOW // 2)) + 1)
    k = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.repeat(first, pieces) + k * (WINDOW // 2)
    return starts, ends, begin, np.minimum(begin + WINDOW, np.repeat(last, pieces))


def wrapped(low: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last word (one more) of windows over two lines or more that no blank line parts."""
    a, b = arrays.spans(arrays.IN_LINE, low, offsets)
    first, last = np.searchsorted(starts, a), np.searchsorted(starts, b)
    a, b, first, last = (x[last > first] for x in (a, b, first, last))
    row = np.searchsorted(offsets, a, "right")
    apart = (a[1:] != b[:-1] + 1) | (row[1:] != row[:-1])
    head, tail = np.flatnonzero(np.r_[True, apart][: len(a)]), np.flatnonzero(np.r_[apart, True][: len(a)])
    first, last = first[head[tail > head]], last[tail[tail > head]]
    pieces = np.maximum(1, -(-(last - first - WINDOW) // STEP) + 1)
    k = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = np.repeat(first, pieces) + k * STEP
    return begin, np.minimum(begin + WINDOW, np.repeat(last, pieces))


def buckets(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature of each word, and of each word with the next; a word said again at once has feature 0, which has no weight."""
    word = arrays.span_hashes(low, starts, ends)
    pair = word.copy()
    pair[:-1] = arrays.mix(word[:-1] * arrays._SEEDS[50] + word[1:] * arrays._SEEDS[51])
    shift = np.uint64(64 - BUCKET_BITS)
    one, two = (word >> shift).astype(np.int64), (pair >> shift).astype(np.int64)
    again = np.flatnonzero(word[1:] == word[:-1])
    one[again + 1] = two[again] = 0
    return one, two


def summed(weights: np.ndarray, one: np.ndarray, two: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Class scores of ranges of words: weights of words and pairs, over the root of their number. Some ranges at a time, as there is a
    row of scores for each word between the first and the last of them."""
    out, order = np.empty((len(begin), weights.shape[1])), np.argsort(begin, kind="stable")
    for k in np.split(order, range(SUMMED, len(order), SUMMED)):
        if not len(k):
            continue
        a, b = int(begin[k[0]]), int(end[k].max())
        total = np.zeros((b - a + 1, weights.shape[1]))
        np.cumsum(weights[one[a:b]], axis=0, out=total[1:])
        pairs = np.zeros_like(total)
        np.cumsum(weights[two[a:b]], axis=0, out=pairs[1:])
        x, y = begin[k] - a, end[k] - a
        out[k] = (total[y] - total[x] + pairs[y - 1] - pairs[x]) / np.sqrt(y - x)[:, None]
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def probabilities(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        logit = (summed(self.weights, *buckets(low, starts, ends), begin, end) + self.bias) / self.temperature
        p = np.exp(logit - logit.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def variations(rng: np.random.Generator, fillers: list[str]) -> tuple[list[str], list[int], list[bool]]:
    """Templates with words dropped and with other words before and after, license talk with made-up names, and if the template is
    the one of its family that is held out for calibration."""
    texts, classes, out = [], [], []
    made_up = lambda: "".join(rng.choice(list("bcdfglmnprstvaeiou"), rng.integers(3, 9))).capitalize()
    for family, templates in (*TEMPLATES.items(), ("unknown", UNFAMILIAR)):
        aside = int(rng.integers(0, len(templates)))
        for place, template in enumerate(templates):
            for k in range(VARIATIONS):
                words = (template.replace("*", made_up()) if "*" in template else template).split()
                if k % 3 == 2 and len(words) > 6:
                    words = [w for w in words if rng.random() > 0.1]
                if k % 2 and fillers:
                    extra = fillers[int(rng.integers(0, len(fillers)))].split()
                    cut = int(rng.integers(0, len(extra) + 1))
                    words = [*extra[max(0, cut - 15) : cut], *words, *extra[cut : cut + 15]]
                texts.append(" ".join(words[: 2 * WINDOW]))
                classes.append(CLASSES.index(family))
                out.append(place == aside)
    return texts, classes, out


def train(plain: list[str], seed: int = 11) -> Model:
    """``plain`` are paragraphs of documents; those with license talk are left out."""
    rng = np.random.default_rng(seed)
    plain = [p for p in plain if not TALK.search(p)][:SAMPLE_PARAGRAPHS]
    texts, classes, aside = variations(rng, plain)
    texts, classes, aside = texts + plain, classes + [len(CLASSES) - 1] * len(plain), aside + (rng.random(len(plain)) < 0.2).tolist()
    data, offsets = arrays.buffers(pa.array([t.replace("\n", " ") for t in texts], pa.string()))
    low = arrays.LOWER[data]
    starts, ends, begin, end = paragraphs(low, offsets)
    row = np.searchsorted(offsets, starts[begin], "right") - 1
    label = np.array(classes)[row]
    # of a longer text, windows that aren't its first only count as examples without a license if it has none
    use = np.concatenate([[True], row[1:] != row[:-1]]) | (label == len(CLASSES) - 1)
    begin, end, row, label = begin[use], end[use], row[use], label[use]
    features, held = buckets(low, starts, ends), np.array(aside)[row]
    first = fit_softmax(features, begin, end, label, ~held)
    scores, truth = (summed(first.weights, *features, begin[held], end[held]) + first.bias), label[held]
    weight = 1 / np.bincount(truth, minlength=len(CLASSES))[truth] if len(truth) else np.empty(0)

    def loss(t: float) -> float:
        x = scores / t
        x = x - x.max(1, keepdims=True)
        return float((weight * (np.log(np.exp(x).sum(1)) - x[np.arange(len(x)), truth])).sum())

    last = fit_softmax(features, begin, end, label, np.ones(len(label), bool))
    last.temperature = float(min(np.geomspace(0.25, 8, 41), key=loss)) if len(truth) else 1.0
    return last


def fit_softmax(features: tuple[np.ndarray, np.ndarray], begin: np.ndarray, end: np.ndarray, label: np.ndarray, use: np.ndarray) -> Model:
    """Multinomial logistic regression on the ranges of words in use, by Adam; classes weigh alike."""
    begin, end, label, c = begin[use], end[use], label[use], len(CLASSES)
    n = end - begin
    runs = lambda size: np.repeat(begin, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    example = np.concatenate([np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(n)), n - 1)])
    feature = np.concatenate([features[0][runs(n)], features[1][runs(n - 1)]])
    order = np.argsort(example, kind="stable")
    example, feature = example[order], feature[order]
    value = (1 / np.sqrt(n))[example].astype(np.float32)
    edge = np.cumsum(2 * n - 1) - (2 * n - 1)
    used, compact = np.unique(feature, return_inverse=True)
    by = np.argsort(compact, kind="stable")
    by_edge = np.searchsorted(compact[by], np.arange(len(used)))
    weight = (1 / np.maximum(np.bincount(label, minlength=c), 1)[label])[:, None]
    weight /= weight.sum()
    target, w, b = np.eye(c)[label], np.zeros((len(used), c), np.float32), np.zeros(c)
    state = [(np.zeros_like(p), np.zeros_like(p)) for p in (w, b)]
    for epoch in range(1, EPOCHS + 1):
        logit = np.add.reduceat(w[compact] * value[:, None], edge) + b
        p = np.exp(logit - logit.max(1, keepdims=True))
        error = (p / p.sum(1, keepdims=True) - target) * weight
        slope = np.add.reduceat((error.astype(np.float32)[example] * value[:, None])[by], by_edge) + 1e-6 * w
        for q, g, (m, v) in zip((w, b), (slope, error.sum(0)), state):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            q -= 0.1 * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-9)
    weights = np.zeros((1 << BUCKET_BITS, c), np.float32)
    weights[used] = w
    weights[0] = 0
    return Model(weights, b, 1.0)


def fit(docs: DataFrame) -> Model:
    """A model whose examples without a license are paragraphs of the SAMPLE_DOCS documents with the lowest hashes, OF_ONE of each at
    most. One task of an executor trains; only the model comes to the driver."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    some = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), "doc_id")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):  # a text at a time; only a few short paragraphs of it go on
                own = [p for p in (batch.column(1)[row].as_py() or "").split("\n") if p.strip()]
                own = [p[:SAMPLE_CHARS] for p in own[:: -(-len(own) // OF_ONE) or 1]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, 1), pa.array([own], pa.list_(pa.string()))], names=["doc_id", "paragraphs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = {i: own for batch in batches for i, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())}
        model = train([p for i in sorted(got) for p in got[i]])
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias.tobytes()], pa.binary()), pa.array([model.temperature])], names=["weights", "bias", "temperature"])

    drawn = some.mapInArrow(draw, "doc_id long, paragraphs array<string>").groupBy("doc_id").agg(F.min("paragraphs").alias("paragraphs"))
    made = drawn.repartition(1).mapInArrow(run, "weights binary, bias binary, temperature double").first()
    weights, bias = (np.frombuffer(bytes(x), kind) for x, kind in ((made.weights, np.float32), (made.bias, np.float64)))
    return Model(weights.reshape(1 << BUCKET_BITS, -1), bias, made.temperature)


def parts_of(text: str) -> set:
    """Words and word pairs."""
    words = re.findall(r"[^\W_]+", text.lower())
    return {*words, *zip(words, words[1:])}


#: Words and pairs of the templates of each family.
NEEDED = {family: [parts_of(t) for t in templates] for family, templates in TEMPLATES.items()}


def confirmed(paragraph: str, family: str) -> int:
    """The template of the family that the paragraph holds most of, or -1 if that isn't enough."""
    have = parts_of(paragraph)
    shares = [len(need & have) / len(need) for need in NEEDED[family]]
    best = int(np.argmax(shares))
    return best if shares[best] >= MIN_CONTAINED else -1


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, n_paragraphs, matches (family, probability, template, start and length in code
    points; family unknown has no template)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, data, offsets in arrays.text_slices(batches, "text"):
            low = arrays.LOWER[data]
            starts, ends, begin, end = paragraphs(low, offsets)
            lines = arrays.spans(arrays.IN_LINE, low, offsets)
            per_line = np.searchsorted(starts, lines[1]) > np.searchsorted(starts, lines[0])
            row = np.searchsorted(offsets, lines[0][per_line], "right") - 1
            count = np.bincount(row, minlength=len(batch))
            found: list[list[dict]] = [[] for _ in range(len(batch))]
            if len(begin):
                n_own, more = len(begin), wrapped(low, offsets, starts)
                begin, end = np.concatenate([begin, more[0]]), np.concatenate([end, more[1]])
                p = shared.value.probabilities(low, starts, ends, begin, end)
                points = np.cumsum((data & 0xC0) != 0x80)
                last = [(-1, -1, "")] * len(batch)
                for k in np.flatnonzero(p.argmax(1) < len(CLASSES) - 1).tolist():
                    a, b = int(starts[begin[k]]), int(ends[end[k] - 1])
                    doc = int(np.searchsorted(offsets, a, "right")) - 1
                    text = data[a:b].tobytes().decode("utf-8", "replace")
                    if k >= n_own:
                        text = re.sub(r"[\W_]+", " ", text)
                    c = int(np.argmax(p[k, :-1]))
                    family = CLASSES[c]
                    template = confirmed(text, family) if c < len(FAMILIES) else -1
                    if template < 0:
                        family = "unknown"
                        if p[k, c] < ODDS * p[k, -1]:
                            continue
                    start = int(points[a] - points[offsets[doc]])
                    if k < n_own and last[doc][2] == family and start < last[doc][1]:  # the same one, in the next window
                        continue
                    length = int(points[b - 1] - points[a] + 1)
                    if k >= n_own:
                        here = [m for m in found[doc] if m["start"] < start + length and start < m["start"] + m["length"]]
                        if any(family in ("unknown", m["family"]) for m in here):
                            continue
                        found[doc] = [m for m in found[doc] if m not in here or m["family"] != "unknown"]
                    last[doc] = (start, start + length, family)
                    found[doc].append({"family": family, "probability": float(p[k, c]), "template": template, "start": start, "length": length})
            for own in found:
                own.sort(key=lambda m: m["start"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(count.astype(np.int64)), pa.array(found, MATCHES)], names=["doc_id", "n_paragraphs", "matches"])

    return bounded(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_paragraphs long, matches array<struct<family:string,probability:double,template:int,start:long,length:long>>")


MATCHES = pa.list_(pa.struct([("family", pa.string()), ("probability", pa.float64()), ("template", pa.int32()), ("start", pa.int64()), ("length", pa.int64())]))


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs, n_matches, n_unknown, license (the likeliest family, else unknown, else none), probability,
    families (all, sorted, joined by commas), start and length of the first match."""
    known = F.filter("matches", lambda m: m["family"] != "unknown")
    best = F.get(F.sort_array(F.transform(known, lambda m: F.struct((-m["probability"]).alias("p"), m["family"].alias("family")))), F.lit(0))
    return scanned.select("*", known.alias("known")).select(
        "doc_id",
        "n_paragraphs",
        F.size("matches").cast("long").alias("n_matches"),
        (F.size("matches") - F.size("known")).cast("long").alias("n_unknown"),
        F.when(F.size("known") > 0, best["family"]).when(F.size("matches") > 0, "unknown").otherwise("none").alias("license"),
        F.when(F.size("known") > 0, -best["p"]).alias("probability"),
        F.array_join(F.array_sort(F.array_distinct("known.family")), ",").alias("families"),
        F.when(F.size("matches") > 0, F.col("matches")[0]["start"]).alias("start"),
        F.when(F.size("matches") > 0, F.col("matches")[0]["length"]).alias("length"),
    )
