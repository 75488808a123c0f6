"""Licences of files: TF-IDF cosine to templates, then inheritance by directory.

A file's licence passages are the lines that speak of a licence, and of a licence
file also all of its text. Their sparse TF-IDF vectors are compared with those of
the templates; the nearest one counts from `least` on. So does a run of words
inside of such a file's text, as many as a template has, from `PART` on: a whole
licence, or a header among other text, is known by it. A file without a licence
of its own inherits that of the licence file in the nearest ancestor directory,
its own directory included, by joins on paths.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelight.llm.workspace import Workspace, look_up

LEAST = 0.6
PART = 0.85
ANCHORS = 3  # words of a template by which runs are found
# Licences by name, each with wordings found in headers and licence files.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "Apache License Version 2.0, January 2004 terms and conditions for use, reproduction, and distribution", "SPDX-License-Identifier: Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"],
    "MIT": ["Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "Redistribution and use in source and binary forms, with or without modification, are permitted. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "SPDX-License-Identifier: BSD-3-Clause"],
    "BSD-2-Clause": ["Licensed under the BSD 2-Clause License", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "SPDX-License-Identifier: BSD-2-Clause"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", "GNU General Public License Version 3, 29 June 2007", "SPDX-License-Identifier: GPL-3.0-only", "either version 3 of the GNU General Public License, or any later version"],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2", "GNU General Public License Version 2, June 1991", "SPDX-License-Identifier: GPL-2.0-only", "either version 2 of the GNU General Public License, or any later version"],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3", "GNU Lesser General Public License Version 3, 29 June 2007", "SPDX-License-Identifier: LGPL-3.0-only"],
    "LGPL-2.1": ["GNU Lesser General Public License Version 2.1, February 1999", "SPDX-License-Identifier: LGPL-2.1-only"],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3", "GNU Affero General Public License Version 3, 19 November 2007", "SPDX-License-Identifier: AGPL-3.0-only"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", "Creative Commons Attribution 4.0 International Public License", "SPDX-License-Identifier: CC-BY-4.0"],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike 4.0 International Public License", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial 4.0 International Public License", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "SPDX-License-Identifier: ISC"],
    "Unlicense": ["This is free and unencumbered software released into the public domain", "SPDX-License-Identifier: Unlicense"],
}
WIDER = {"BSD-2-Clause": "BSD-3-Clause"}  # whose text holds all of the first one's
SPEAKS = re.compile(r"licen[sc]e|copyright|spdx|is hereby granted|redistribution and use|public domain", re.I)
TERM = re.compile(r"[a-z]+|[0-9]+(?:\.[0-9]+)*")
LICENCE_FILE = r"(?i)(^|/)(licen[sc]e|copying|unlicense)([._-][^/]*)?$"


def terms(text: str) -> Counter:
    return Counter(TERM.findall(text.lower()))


class Templates:
    """TF-IDF vectors of the templates; words that none has weigh as those that one has."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES) -> None:
        words = [(name, TERM.findall(t.lower())) for name, texts in templates.items() for t in texts]
        rows = [(name, Counter(w)) for name, w in words]
        seen = Counter(w for _, r in rows for w in r)
        self.most = math.log((1 + len(rows)) / 2) + 1
        self.idf = {w: math.log((1 + len(rows)) / (1 + n)) + 1 for w, n in seen.items()}
        self.rows = [(name, v, self._norm(v)) for name, v in ((name, self._weigh(r)) for name, r in rows)]
        self.sizes = [len(w) for _, w in words]
        self.numbers = [{x for x in w if x[0].isdigit()} for _, w in words]
        self.anchors: dict[str, list[tuple[int, int]]] = {}
        for i, (_, w) in enumerate(words):
            for x in sorted(set(w), key=lambda x: (seen[x], -len(x), x))[:ANCHORS]:
                self.anchors.setdefault(x, []).extend((i, at) for at, y in enumerate(w) if x == y)

    def _weigh(self, counts: Counter) -> dict[str, float]:
        return {w: (1 + math.log(n)) * self.idf.get(w, self.most) for w, n in counts.items()}

    @staticmethod
    def _norm(v: dict[str, float]) -> float:
        return math.sqrt(sum(x * x for x in v.values())) or 1.0

    def nearest(self, text: str) -> tuple[str | None, float]:
        """The most similar licence and its cosine; ties go to the earlier template."""
        mine = self._weigh(terms(text))
        norm = self._norm(mine)
        best: tuple[str | None, float] = (None, 0.0)
        for name, v, other in self.rows:
            score = sum(x * mine[w] for w, x in v.items() if w in mine) / norm / other
            if score > best[1] + 1e-12:
                best = (name, score)
        return best

    def inside(self, text: str) -> tuple[str | None, float]:
        """The licence most similar to a run of words of the text, from `PART` on, and its cosine; a run has all numbers of the template."""
        words = TERM.findall(text.lower())
        starts = {(i, max(0, at - place)) for at, w in enumerate(words) for i, place in self.anchors.get(w, ())}
        top: dict[str, float] = {}
        best: tuple[str | None, float] = (None, 0.0)
        for i, start in sorted(starts):
            run = Counter(words[start : start + self.sizes[i]])
            if not self.numbers[i] <= run.keys():
                continue
            name, v, other = self.rows[i]
            mine = self._weigh(run)
            score = sum(x * mine[w] for w, x in v.items() if w in mine) / self._norm(mine) / other
            if score >= PART:
                top[name] = max(score, top.get(name, 0.0))
                if score > best[1] + 1e-12:
                    best = (name, score)
        wider = WIDER.get(best[0] or "")
        return (wider, top[wider]) if wider in top else best


def passages(text: str, whole: bool) -> list[str]:
    spoken = [line for line in text.split("\n") if SPEAKS.search(line)] if SPEAKS.search(text) else []
    return [text, *spoken] if whole else spoken


def own_licenses(files: DataFrame, path_col: str, text_col: str, least: float = LEAST, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """`files` with `own_license` (NULL if none) and `score`, of the most similar passage."""
    held = Templates(templates)

    @F.pandas_udf("own_license string, score double")
    def match(texts: pd.Series, whole: pd.Series) -> pd.DataFrame:
        out = []
        for text, is_file in zip(texts, whole, strict=True):
            parts = passages(text, is_file)
            best = max((held.nearest(p) for p in parts), key=lambda b: b[1], default=(None, 0.0))
            run = held.inside(text) if parts else best
            best = run if run[1] >= PART and (run[1] >= best[1] or WIDER.get(best[0] or "") == run[0]) else best
            out.append(best if best[1] >= least else (None, best[1]))
        return pd.DataFrame(out, columns=["own_license", "score"])

    whole = F.coalesce(F.col(path_col).rlike(LICENCE_FILE), F.lit(False))
    found = files.withColumn("_m", match(F.coalesce(F.col(text_col).cast("string"), F.lit("")), whole))
    return found.select(*files.columns, "_m.own_license", "_m.score")


def scan(files: DataFrame, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """(id, path, own_license, score, license, license_dir) per row of `files`.

    `license` is the own one or else the one inherited, `license_dir` the directory
    it comes from, NULL for an own one. Of several licence files of a directory the
    most similar counts, then the first name, then the first path. NULL texts have
    no licence, NULL paths inherit none; repeated rows each give a row; an empty
    table gives none. Other columns are not read.
    """
    space = Workspace(files.sparkSession)
    rows = files.select(F.col(id_col).alias("_id"), F.col(path_col).cast("string").alias("_path"), F.col(text_col).cast("string").alias("_text"))
    narrow = space.keep(own_licenses(rows, "_path", "_text", least).select("_id", "_path", F.regexp_replace("_path", "/?[^/]*$", "").alias("_dir"), "own_license", "score"), "own")
    named = narrow.where(F.col("_path").rlike(LICENCE_FILE) & F.col("own_license").isNotNull())
    top = named.groupBy("_dir").agg(F.max("score").alias("top"))
    given = named.join(top.withColumnRenamed("_dir", "_d"), (F.col("_dir") == F.col("_d")) & (F.col("score") == F.col("top"))).groupBy("_dir").agg(F.min("own_license").alias("given"))
    dirs = space.keep(narrow.where("_dir IS NOT NULL").groupBy("_dir").agg(F.count("*").alias("members")), "dirs")
    # A directory's ancestors, itself first; the root is the empty path.
    parts = F.split("_dir", "/")
    ups = F.when(F.col("_dir") == "", F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, F.size(parts) - k), "/")))
    chain = space.keep(dirs.select("_dir", F.posexplode(ups).alias("steps", "_up")), "chain")
    counts = chain.groupBy("_up").agg(F.count("*").alias("members"))
    facts = space.keep(counts.join(given, F.col("_up") == F.col("_dir")).select("_up", "members", "given"), "facts")
    reached = look_up(chain, facts, "_up", "members").where("given IS NOT NULL")
    nearest = reached.groupBy("_dir").agg(F.min(F.struct("steps", "_up", "given")).alias("n"))
    inherited = nearest.join(dirs.withColumnRenamed("_dir", "_d"), F.col("_dir") == F.col("_d")).select("_dir", "members", F.col("n._up").alias("up"), F.col("n.given").alias("given"))
    inherited = space.keep(inherited, "inherited")
    both = look_up(narrow, inherited, "_dir", "members")
    own = F.col("own_license").isNotNull()
    result = both.select(F.col("_id").alias(id_col), F.col("_path").alias(path_col), "own_license", "score", F.coalesce("own_license", "given").alias("license"), F.when(~own, F.col("up")).alias("license_dir"))
    result = space.keep(result, "result")
    space.close("result")
    return result


def document_paths(docs: DataFrame) -> DataFrame:
    """(doc_id, path, text): documents as files of a tree by source, language and id; one with a licence line of its own is a licence file of its directory."""
    spoken = F.coalesce("text", F.lit("")).rlike(r"(?i)\blicen[sc]ed?\b")
    name = F.when(spoken, F.concat(F.lit("LICENSE-"), F.col("doc_id"))).otherwise(F.concat(F.lit("doc-"), F.col("doc_id"), F.lit(".txt")))
    part = F.expr("doc_id div 500").cast("string")
    return docs.select("doc_id", F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), part, name).alias("path"), "text")
