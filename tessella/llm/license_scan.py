"""License scan by conditional compression.

Blocks of text around licensing words are compressed alone and with each template as raw
zstandard dictionary; the relative size reductions rank the templates. The exact wording alone
decides, for every template: the words that differ between template and block are listed, and
only few of them may, none a version, a code or a name.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import common as C

#: Customary wordings of license notices.
TEMPLATES: dict[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-full": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "MIT": "Released under the MIT License.",
    "MIT-full": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software',
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Proprietary": "All rights reserved.",
}

_CUE = re.compile(
    rb"licen[cs]|copyright|all\s+rights\s+reserved|public\s+domain|permission\s+(?:is\s+hereby|to\s+use)|redistribution|warrant|spdx",
    re.I,
)
_SPACE = re.compile(rb"\s")
#: Bytes of context before a cue and after it, and the length at which a block is divided.
BEFORE, AFTER, BLOCK = 400, 700, 4000


def blocks_of(text: bytes) -> list[tuple[int, int]]:
    """Byte ranges around licensing words; near ones are merged, long ones go on in an overlapping block."""
    out: list[list[int]] = []
    for m in _CUE.finditer(text):
        start = max(0, m.start() - BEFORE)
        end = min(len(text), m.end() + AFTER)
        if out and start <= out[-1][1] and end - out[-1][0] <= BLOCK:
            out[-1][1] = end
        else:
            out.append([start, end])
    for block in out:  # whole words only
        while 0 < block[0] and not _SPACE.match(text, block[0] - 1) and block[0] < block[1]:
            block[0] += 1
        while block[1] < len(text) and not _SPACE.match(text, block[1]) and block[1] > block[0]:
            block[1] -= 1
    return [(a, b) for a, b in out if a < b]


def _words(text: str) -> list[str]:
    return [w.strip(".,;:()\"'") for w in text.split()]


def _telling(word: str) -> bool:
    return any(c.isdigit() for c in word) or (len(word) > 1 and word.isupper()) or word in (
        "Lesser", "Affero", "General", "Apache", "Mozilla",
    )


def differences(template: str, block: str) -> tuple[list[str], list[str], bool]:
    """Template words that the block lacks, block words between matched ones, and whether a telling word differs."""
    want, have = _words(template), _words(block)
    match = SequenceMatcher(None, [w.lower() for w in want], [w.lower() for w in have], autojunk=False)
    pieces = [b for b in match.get_matching_blocks() if b.size]
    if not pieces:
        return want, [], True
    # The run of pieces with the most template words whose gaps are not longer than the template.
    best: list = []
    run: list = []
    for p in pieces:
        if run and p.b - (run[-1].b + run[-1].size) > max(4, len(want) // 4):
            run = []
        run = [*run, p]
        if sum(x.size for x in run) > sum(x.size for x in best):
            best = run
    got = {i for p in best for i in range(p.a, p.a + p.size)}
    lacking = [w for i, w in enumerate(want) if i not in got]
    inner = {i for p in best for i in range(p.b, p.b + p.size)}
    extra = [have[i] for i in range(best[0].b, best[-1].b + best[-1].size) if i not in inner]
    return lacking, extra, any(map(_telling, lacking + extra))


class Scanner:
    """Ranks templates for blocks; equal blocks are judged once per worker."""

    def __init__(self, templates: dict[str, str], tolerance: float):
        self.templates, self.tolerance = templates, tolerance
        self.sizes = {name: len(text.split()) for name, text in templates.items()}
        self.wanted = {name: [w.lower() for w in _words(text)] for name, text in templates.items()}
        self.telling = {name: {w.lower() for w in _words(text) if _telling(w)} for name, text in templates.items()}
        self.plain = zstandard.ZstdCompressor(level=9)
        self.with_template = {
            name: zstandard.ZstdCompressor(
                level=9,
                dict_data=zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT),
            )
            for name, text in templates.items()
        }
        self.judge = lru_cache(50_000)(self._judge)

    def rank(self, block: bytes) -> list[tuple[float, str]]:
        """Size reductions in shares of the smaller of block and template, best first."""
        alone = len(self.plain.compress(block))
        return sorted(
            (
                (round((alone - len(c.compress(block))) / min(alone, len(self.plain.compress(self.templates[n].encode()))), 4), n)
                for n, c in self.with_template.items()
            ),
            key=lambda x: (-x[0], x[1]),
        )

    def possible(self, name: str, have: set[str]) -> bool:
        """Whether ``have``, a block's words, leaves the template a chance: words that stand nowhere in it are lacking."""
        return self.telling[name] <= have and sum(w not in have for w in self.wanted[name]) <= self.tolerance * self.sizes[name]

    def _judge(self, block: bytes) -> list[tuple[str, float, str, str]]:
        """Confirmed templates of a block: (name, reduction, lacking words, extra words)."""
        out = []
        text = block.decode("utf-8", "replace")
        have = {w.lower() for w in _words(text)}
        for reduction, name in self.rank(block):
            if not self.possible(name, have):
                continue
            lacking, extra, telling = differences(self.templates[name], text)
            if not telling and len(lacking) + len(extra) <= self.tolerance * self.sizes[name]:
                out.append((name, reduction, " ".join(lacking), " ".join(extra)))
        return out

    def scan(self, text: bytes) -> tuple[int, list[dict]]:
        found, blocks = {}, blocks_of(text)
        for start, end in blocks:
            for name, reduction, lacking, extra in self.judge(text[start:end]):
                if name not in found or reduction > found[name]["reduction"]:
                    found[name] = {
                        "license": name, "start": start, "end": end, "reduction": reduction, "lacking": lacking, "extra": extra
                    }
        return len(blocks), sorted(found.values(), key=lambda x: (x["start"], x["license"]))


_FOUND = "license: string, start: bigint, end: bigint, reduction: double, lacking: string, extra: string"


def _scan(*args):
    def run(batches):
        scanner = Scanner(*args)
        kind = pa.list_(
            pa.struct(
                [("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reduction", pa.float64()),
                 ("lacking", pa.string()), ("extra", pa.string())]
            )
        )
        for batch in C.slices(batches):
            n, found = [], []
            for text in C.texts_as_bytes(batch.column(1)):
                blocks, hits = scanner.scan(text)
                n.append(blocks)
                found.append(hits)
            names = [",".join(sorted({x["license"] for x in hits})) for hits in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(names, pa.string()), pa.array(found, kind)],
                names=["doc_id", "n_blocks", "licenses", "found"],
            )

    return run


def scan_licenses(
    docs: DataFrame,
    templates: dict[str, str] | None = None,
    tolerance: float = 0.1,
) -> DataFrame:
    """Finds license wordings in ``docs`` (doc_id, text), whole texts.

    Returns a row per document: doc_id, n_blocks (candidate blocks), licenses (confirmed names, in
    alphabetical order, comma-joined) and found (license, start and end of the block in UTF-8
    bytes, reduction, lacking and extra words). Whatever their reductions, all templates are
    compared with a block word by word unless its words rule them out; up to ``tolerance`` of a
    template's words may differ. A null text counts as empty; repeated rows get equal results;
    further columns are ignored; an empty table gives no rows.
    """
    return docs.select(*C.id_and_text(docs)).mapInArrow(
        _scan(dict(templates or TEMPLATES), tolerance),
        f"doc_id long, n_blocks long, licenses string, found array<struct<{_FOUND}>>",
    )
