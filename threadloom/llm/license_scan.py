"""License texts by conditional compression: words around a trigger that a template helps to compress are compared with it one by one."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter, OrderedDict
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Short notices by which texts state their license.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has dedicated all copyright to the public domain under CC0 1.0.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "ISC": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted.",
    "All-rights-reserved": "All rights reserved.",
    "Proprietary": "All rights reserved. No part of this work may be reproduced without written permission.",
}
#: What makes a place a candidate, besides words of the templates themselves (see Scanner); the scan for them reads whole texts.
TRIGGER = re.compile(r"licen[cs]|copyright|all\s+rights\s+reserved|permission|redistribut|public\s+domain|cc[\s-]by|cc0|\bmit\b|\bgpl|apache|mozilla|creative\s+commons", re.IGNORECASE)

FOUND = "array<struct<line: int, first_word: int, license: string, gain: double, differences: int, confirmed: boolean>>"
_WORD = re.compile(r"[0-9a-z\u0080-\U0010ffff]+")
_PLACE = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass
class Scanner:
    """gain: least share of the bytes which a template saves on itself that it must save on the words around a trigger; slack: differing words a confirmed one may have, as a share of its own."""

    templates: dict[str, str]
    gain: float = 0.3
    slack: float = 0.1
    level: int = 3
    _seen: OrderedDict = field(default_factory=OrderedDict)

    def __post_init__(self):
        self.words = {k: words(t) for k, t in self.templates.items()}
        self.dicts = {k: zstandard.ZstdCompressionDict(t.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT) for k, t in self.templates.items()}
        self.packers = {k: zstandard.ZstdCompressor(level=self.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False) for k, d in self.dicts.items()}
        self.bare = zstandard.ZstdCompressor(level=self.level, write_content_size=False, write_checksum=False)
        self.counts = {k: Counter(w) for k, w in self.words.items()}
        self.own = {k: max(1, len(self.bare.compress(d)) - len(self.packers[k].compress(d))) for k, w in self.words.items() for d in [" ".join(w).encode()]}
        self.reach = {k: len(w) + int(self.slack * len(w)) for k, w in self.words.items()}
        self.longest = max(self.reach.values(), default=0)
        # of each template one word more than a confirmed place may lack, so none is missed, whatever the templates
        own = {x for w in self.words.values() for x in sorted(set(w), key=lambda x: (not TRIGGER.search(x), -len(x), x))[: int(self.slack * len(w)) + 1]}
        part = "[0-9a-z\u0080-\U0010ffff]"
        self.trigger = re.compile("|".join([TRIGGER.pattern, *(f"(?<!{part}){re.escape(x)}(?!{part})" for x in sorted(own))]), re.IGNORECASE)

    def __getstate__(self):
        return {"templates": self.templates, "gain": self.gain, "slack": self.slack, "level": self.level}

    def __setstate__(self, state):
        self.__init__(**state)

    def differences(self, name: str, block: list[str]) -> tuple[int, int, int]:
        """Words to change, add or leave out to turn the template into the block's nearest run, and where that starts and stops."""
        want = self.words[name]
        # edit distance to every run of the block at once: a run may start anywhere for nothing
        row = [(0, j) for j in range(len(block) + 1)]
        for i, w in enumerate(want, 1):
            last, row = row, [(i, 0)]
            for j, b in enumerate(block, 1):
                row.append(min((last[j - 1][0] + (w != b), last[j - 1][1]), (last[j][0] + 1, last[j][1]), (row[j - 1][0] + 1, row[j - 1][1])))
        wrong, start, stop = min((x, a, j) for j, (x, a) in enumerate(row))
        return wrong, start, stop

    def around(self, block: tuple[str, ...], first: int, last: int) -> list[tuple]:
        """(start, stop, license, gain, differences, confirmed) of templates near the words first to last of a block; equal blocks are compressed once.

        No confirmed one is lost to the gain: all whose words are there, but for slack, are compared."""
        key = (block, first, last)
        if key in self._seen:
            self._seen.move_to_end(key)
            return self._seen[key]
        out, data, count = [], " ".join(block).encode(), Counter(block)
        alone = len(self.bare.compress(data))
        for name, want in self.words.items():
            gain = min(1.0, (alone - len(self.packers[name].compress(data))) / self.own[name])
            few = self.slack * len(want)
            if gain >= self.gain or sum((self.counts[name] - count).values()) <= few:
                low = max(0, last - self.reach[name])
                wrong, start, stop = self.differences(name, list(block[low : first + self.reach[name]]))
                if wrong <= few or gain >= self.gain:
                    out.append((low + start, low + stop, name, gain, wrong, wrong <= few))
        self._seen[key] = out
        if len(self._seen) > 10_000:
            self._seen.popitem(last=False)
        return out

    def scan(self, text: str | None) -> list[dict]:
        """Every confirmed template, once for each place; around a trigger outside of these the nearest of the others."""
        text = text or ""
        triggers = [(m.start(), m.end()) for m in self.trigger.finditer(text)]
        if not triggers:
            return []
        # lower() may change a text's length, so places are those of the text as it is
        spans = [(m.start(), m.end()) for m in _PLACE.finditer(text)]
        have = [text[a:b].lower() for a, b in spans]
        begins, ends = [a for a, _ in spans], [b for _, b in spans]
        sure, rest = {}, []
        for a, b in triggers:
            first, last = bisect_right(ends, a), bisect_left(begins, b)  # the words that the trigger touches
            low = max(0, last - self.longest)
            near = []
            for start, stop, name, gain, wrong, ok in self.around(tuple(have[low : first + self.longest]), first - low, last - low):
                if ok:
                    sure[low + start, name] = (low + stop, gain, wrong)
                else:
                    near.append((wrong, -gain, name, low + start))
            if near:
                rest.append((first, *min(near)))
        # of templates that are confirmed by the same words, the one that explains most of them
        out, inside = [], []
        for (at, name), (stop, gain, wrong) in sorted(sure.items(), key=lambda x: (x[1][2] - len(self.words[x[0][1]]), x[1][2], x[0])):
            if not any(at < b and a < stop for a, b in inside):
                inside.append((at, stop))
                out.append((at, name, gain, wrong, True))
        out += {(at, name): (at, name, -gain, wrong, False) for first, wrong, gain, name, at in rest if not any(a <= first < b for a, b in inside)}.values()
        lines = [-1, *(m.start() for m in re.finditer("\n", text))]
        rows = []
        for at, *hit in sorted(out):
            line = bisect_left(lines, begins[at] if at < len(begins) else len(text)) - 1
            rows.append(dict(zip(("line", "first_word", "license", "gain", "differences", "confirmed"), (line, at - bisect_left(begins, lines[line]), *hit), strict=True)))
        return rows


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, text_col: str = "text", name: str = "licenses", **limits: float) -> DataFrame:
    """docs and, for each text, the places that a template helps to compress by limits' gain at least: the line and word where it starts, the template, the share saved, the words that differ, and whether these are few enough to confirm it.

    Around every trigger of the whole text, words as far as a template is long are compared with it, across line ends; all confirmed templates count. Triggers are TRIGGER and, of each template, one word more than a confirmed place may lack. A null or empty text has none. No row moves.
    A column of docs that has the name is replaced.
    """
    scanner = Scanner(templates or TEMPLATES, **limits)

    @F.arrow_udf(FOUND)
    def scan(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("line", pa.int32()), ("first_word", pa.int32()), ("license", pa.string()), ("gain", pa.float64()), ("differences", pa.int32()), ("confirmed", pa.bool_())]))
        return pa.array([scanner.scan(t.as_py()) for t in texts], kind)

    return docs.withColumn(name, scan(F.col(f"`{text_col}`").cast("string")))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    confirmed = F.filter("licenses", lambda x: x["confirmed"])
    names = F.array_sort(F.array_distinct(F.transform(confirmed, lambda x: x["license"])))
    return found.select("doc_id", F.size("licenses").cast("long").alias("n_blocks"), F.size(confirmed).cast("long").alias("n_confirmed"), F.array_join(names, ",").alias("licenses"),
                        F.coalesce(F.array_min(F.transform(confirmed, lambda x: x["differences"])), F.lit(-1)).alias("least_differences"), F.round(F.coalesce(F.array_max(F.transform("licenses", lambda x: x["gain"])), F.lit(0.0)), 6).alias("best_gain"))
