"""License scans by conditional compression.

A candidate block is a mention of a licence (or a few near each other) with as many words on either side as the template's wording
can take. It is compressed with zstandard alone and with the template as raw dictionary, for every template, and the templates are
ranked by the bytes that their dictionaries save. Down that ranking each template is
confirmed by its exact wording differences: a place near the mention holds its words in order, but for fillers, with no version or
variant put between, no word of it missing, none that denies put between or before, and the dictionary saves at least
`LEAST_GAIN` of the place's bytes. Short templates (a name beside the word licence) stay in one paragraph and allow nothing
between but fillers and other licences' names; long ones run over any number of paragraphs and allow a few other words. Of
overlapping places that of the higher rank stays, so a notice may be wrapped over lines, several licences may stand in one line,
and a text with a clause more than another's counts as its own licence. "All rights reserved" straight before a full text is that
text's heading, not a licence. `or_later` says that later versions are allowed as well. Lines that mention a licence and hold no
such place are reported unconfirmed, directly following ones as one row, with the template that saves most.

A licence found several times in a block is one row for each template that says it without overlap. Of equal gains the
template listed first wins. Null and empty texts have no rows; repeated rows repeat theirs; an empty table gives an empty
result; a very long text costs its length and, for each mention, a window of words. Extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_right

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from vane.llm.text_batches import map_texts

#: Licence identifiers and their published texts and usual notices.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under MIT."),
    ("MIT", "License: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("ISC", "Released under the ISC License."),
    ("ISC", "License: ISC"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "License: Apache-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Released under the GNU General Public License, version 3."),
    ("GPL-3.0", "License: GPL-3.0"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "Released under the GNU General Public License, version 2."),
    ("GPL-2.0", "License: GPL-2.0"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "Released under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "License: LGPL-3.0"),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "Released under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "License: AGPL-3.0"),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "License: BSD-3-Clause"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License."),
    ("BSD-2-Clause", "License: BSD-2-Clause"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\""),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Released under the Mozilla Public License, version 2.0."),
    ("MPL-2.0", "License: MPL-2.0"),
    ("EPL-2.0", "Made available under the terms of the Eclipse Public License 2.0."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("WTFPL", "Released under the Do What The Fuck You Want To Public License."),
    ("Unlicense", "License: Unlicense"),
    ("Zlib", "License: Zlib"),
    ("EPL-2.0", "License: EPL-2.0"),
    ("BSL-1.0", "License: BSL-1.0"),
    ("CC0-1.0", "License: CC0-1.0"),
    ("WTFPL", "License: WTFPL"),
    ("LGPL-2.1", "License: LGPL-2.1"),
    ("proprietary", "All rights reserved."),
]
TEMPLATES += [(name, f"SPDX-License-Identifier: {name}") for name in dict.fromkeys(name for name, _ in TEMPLATES) if name != "proprietary"]
MENTION = re.compile(r"licen[sc]e|copyright|rights reserved|creative commons|public domain|permission (?:is|to use)|redistributions? (?:and use|of source|in binary)|\bCC[ -]BY|\bCC0", re.IGNORECASE)
WORDS = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
#: Words that notices exchange freely.
FILLERS = frozenset("this work is are released distributed made available under the a an of to in version v by terms subject and spdx identifier".split())
#: Words that deny a licence.
DENIALS = frozenset("not no never non without nor neither isn aren wasn don doesn cannot nicht kein keine pas sin unlike".split())
#: Full texts are not taken as found if the dictionary saves less than this share of the bytes.
LEAST_GAIN = 0.15


PARTS = re.compile(r"[a-z0-9]+(?:\.[a-z0-9]+)*", re.IGNORECASE)
#: Words that make another licence of a notice.
VARIANT = re.compile(r"\d.*|nc|nd|sa|lesser|affero|noncommercial|noderivatives|sharealike", re.DOTALL)
#: Words that a template needs to count as long; other words that may stand between a long one's words, beside as many as it has.
LONG, PUT = 8, 8
#: Words that may stand between the words of a short template, besides fillers: other licences in a list.
LISTED = frozenset("or both either dual dually mit isc apache gpl lgpl agpl bsd mpl clause".split())


def words(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def part(word: str) -> str:
    """Lower case, one spelling of licence, without the v and the .0 of versions."""
    low = word.lower()
    return "license" if low in ("licence", "licensed", "licenced", "licenses", "licences") else re.sub(r"^v(?=\d)|(?<=\d)\.0$", "", low)


def template_parts(template: str) -> tuple[list[str], int]:
    """The words that a notice must have, and how many the template has."""
    found = [part(w) for w in PARTS.findall(template)]
    return [w for w in found if w not in FILLERS], len(found)


def stops(parts: list[str], k: int, before: int, long: bool) -> bool:
    """Whether word k may not stand between the wording's word at before and its next one. A version behind another licence's name is that licence's own."""
    word = parts[k]
    if word[0].isdigit():
        return not long and not (k - 1 > before and parts[k - 1] in LISTED and parts[k - 1] != "clause")
    return bool(VARIANT.fullmatch(word)) or not (long or word in FILLERS or word in LISTED)


def find_wording(needed: list[str], size: int, places: dict[str, list[int]], parts: list[str], start: int = 0) -> tuple[int, int] | None:
    """First and last word of the first place, from start on, that holds the needed words in order."""
    long = len(needed) >= LONG
    for first in places.get(needed[0], ()) if needed else ():
        if first < start:
            continue
        at = first
        for word in needed[1:]:
            end = min(len(parts), first + 2 * size + PUT)
            at = next((k for k in range(at + 1, end) if parts[k] == word or stops(parts, k, at, long)), -1)
            if at < 0 or parts[at] != word:
                break
        else:
            return first, at
    return None


#: Licences whose notices may allow later versions, and how they say so: after a name, and within a full text.
WITH_VERSIONS = ("GPL-", "LGPL-", "AGPL-")
OR_LATER = re.compile(r"-or-later\b|\+(?!\w)|[\s,;(]*\bor\s+\(?(?:at\s+your\s+option\)?,?\s+)?(?:any\s+)?(?:later|newer)\b(?:\s+versions?\b)?", re.IGNORECASE)
LATER_VERSION = re.compile(r"\bany\s+later\s+version\b", re.IGNORECASE)
BLANK_LINE = re.compile(r"\n[^\S\n]*\n")
SENTENCE_END = re.compile(r"[.!?][\"')\]]*\s|\n[^\S\n]*\n")


def denied(text: str, tokens: list[re.Match], parts: list[str], first: int, last: int, size: int) -> bool:
    """Whether a word that denies is one of the four words before in the sentence, fillers aside, or, in a short template's place, between."""
    seen, k = 0, first
    while k and seen < 4 and not SENTENCE_END.search(text, tokens[k - 1].end(), tokens[k].start()):
        k -= 1
        if parts[k] in DENIALS:
            return True
        seen += parts[k] not in FILLERS
    return size < LONG and any(w in DENIALS for w in parts[first : last + 1])


def mention_groups(text: str) -> tuple[list[re.Match], list[tuple[int, int]]]:
    """The words of a text that mentions a licence, and the first and last mention of each group (at most PUT words apart), as words."""
    mentions = [m.start() for m in MENTION.finditer(text)]
    if not mentions:
        return [], []
    tokens = list(PARTS.finditer(text))
    ends, out = [m.end() for m in tokens], []
    for at in mentions:
        word = min(bisect_right(ends, at), len(tokens) - 1)
        if out and word - out[-1][0] <= PUT:
            out[-1] = (out[-1][0], word)
        else:
            out.append((word, word))
    return tokens, out


def ranking_of(text: str, tokens: list[re.Match], first: int, last: int, needs: list[tuple[list[str], int]], tools: Compressors) -> list[tuple[int, int]]:
    """(bytes saved, template), most first: what every template saves of the block around the mentions first to last that is as wide as its wording may be."""
    by_size: dict[int, list[int]] = {}
    for t, (_, size) in enumerate(needs):
        by_size.setdefault(size, []).append(t)
    saved = []
    for size, ts in by_size.items():
        a, b = max(0, first - 2 * size - PUT), min(len(tokens), last + 2 * size + PUT + 1)
        _, gains = tools.gains(text[tokens[a].start() : tokens[b - 1].end()].encode("utf-8", "surrogatepass"), ts)
        saved += zip(gains, ts)
    return sorted(saved, key=lambda x: (-x[0], x[1]))


def wording_place(text: str, tokens: list[re.Match], parts: list[str], places: dict[str, list[int]], needed: list[str], size: int) -> tuple[int, int, int, int] | None:
    """(start, end, start and end of the licence's name) of a template's wording in a block of words."""
    at, long = 0, len(needed) >= LONG
    while found := find_wording(needed, size, places, parts, at):
        first, last = found
        at, core = first + 1, [k for k in range(first, last + 1) if parts[k] in needed]
        if not long and BLANK_LINE.search(text, tokens[first].end(), tokens[last].start()):
            continue
        acronym = next((k for k in (first, last) if parts[k] in ("mit", "isc")), None)
        if (acronym is not None and not tokens[acronym][0].isupper()) or denied(text, tokens, parts, first, last, len(needed)):
            continue
        while first and parts[first - 1] in FILLERS and "\n" not in text[tokens[first - 1].end() : tokens[first].start()] and not re.search(r"[.;:!?]", text[tokens[first - 1].end() : tokens[first].start()]):
            first -= 1
        while last + 1 < len(parts) and parts[last + 1] in FILLERS and text[tokens[last].end() : tokens[last + 1].start()].strip(" \t") == "":
            last += 1
        to = tokens[last].end()
        name = [k for k in core if parts[k] != "license"] or core
        return tokens[first].start(), to + len(re.match(r"[.,;:!?)]*", text[to : to + 4])[0]), tokens[name[0]].start(), tokens[name[-1]].end()
    return None


def confirmed_places(text: str, templates: list[tuple[str, str]], needs: list[tuple[list[str], int]], tools: Compressors) -> list[tuple[int, int, int, int, int, int, bool]]:
    """(start, end, template, bytes alone, bytes saved, rank of the template in its block, later versions allowed) of the places that confirm a template."""
    tokens, groups = mention_groups(text)
    reach = max((2 * size + PUT for _, size in needs), default=0)
    found = []
    for first, last in groups:
        mine = tokens[max(0, first - reach) : last + reach + 1]
        parts = [part(m[0]) for m in mine]
        places: dict[str, list[int]] = {}
        for k, w in enumerate(parts):
            places.setdefault(w, []).append(k)
        for rank, (saved, t) in enumerate(ranking_of(text, tokens, first, last, needs, tools), 1):
            place = wording_place(text, mine, parts, places, *needs[t])
            if place is None:
                continue
            alone, (gain,) = tools.gains(text[place[0] : place[1]].encode("utf-8", "surrogatepass"), [t])
            if gain >= LEAST_GAIN * alone:
                found.append((-saved, t, *place, alone, gain, rank))
    out, names = [], []
    for _, t, start, end, *name, alone, gain, rank in sorted(found):
        if all(name[1] <= s or e <= name[0] for s, e in names):  # "License: A or B": the names stand apart
            names.append(name)
            later = False
            if templates[t][0].startswith(WITH_VERSIONS):
                after = OR_LATER.match(text, name[1])
                later = bool(after or LATER_VERSION.search(text, start, end))
                end = max(end, after.end() if after else end)
            out.append((start, end, t, alone, gain, rank, later))
    return out


def is_heading(text: str, place: tuple, places: list[tuple], templates: list[tuple[str, str]], needs: list[tuple[list[str], int]]) -> bool:
    """Whether a reservation of rights stands straight before a full text."""
    return templates[place[2]][0] == "proprietary" and any(len(needs[p[2]][0]) >= LONG and p[0] >= place[1] and not PARTS.search(text, place[1], p[0]) for p in places)


def blocks(text: str, taken: list[tuple[int, int]] = ()) -> list[tuple[int, int]]:
    """(start, end) of runs of lines that mention a licence and hold nothing of the taken spans."""
    if not MENTION.search(text):
        return []
    out, at = [], 0
    for line in text.split("\n"):
        if MENTION.search(line) and not any(s <= at + len(line) and at < e for s, e in taken):
            if out and out[-1][1] + 1 == at:
                out[-1] = (out[-1][0], at + len(line))
            else:
                out.append((at, at + len(line)))
        at += len(line) + 1
    return out


class Compressors:
    def __init__(self, templates: list[tuple[str, str]], level: int = 3):
        self.plain = zstandard.ZstdCompressor(level=level)
        self.given = [zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for _, t in templates]

    def gains(self, block: bytes, templates: list[int] | None = None) -> tuple[int, list[int]]:
        """Bytes without a dictionary, and what each template's saves."""
        alone = len(self.plain.compress(block))
        return alone, [alone - len(c.compress(block)) for c in (self.given if templates is None else [self.given[t] for t in templates])]


def wording(template: str, block: str) -> tuple[list[str], list[str]]:
    """Template words missing from the block, and words put between the template's own."""
    a, b = words(template), words(block)
    missing, put = [], []
    for tag, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if tag in ("replace", "delete"):
            missing += a[i:j]
        if tag in ("replace", "insert") and 0 < i < len(a):
            put += b[k:m]
    return missing, put


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """doc_id, start, end, license, confirmed, plain_bytes, gain_bytes, rank, or_later, missing, added, block_text: one row a template found or unconfirmed block."""
    templates = TEMPLATES if templates is None else templates
    needs = [template_parts(t) for _, t in templates]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        tools = work.__dict__.get("tools") or work.__dict__.setdefault("tools", Compressors(templates))
        out = []
        for row, text in enumerate(batch.column("text").to_pylist()):
            text = text or ""
            places = confirmed_places(text, templates, needs, tools)
            mine = [(*p[:3], True, *p[3:]) for p in places if not is_heading(text, p, places, templates, needs)]
            for start, end in blocks(text, [p[:2] for p in places]):
                alone, gains = tools.gains(text[start:end].encode("utf-8", "surrogatepass"))
                t = min(range(len(templates)), key=lambda t: (-gains[t], t))
                mine.append((start, end, t, False, alone, gains[t], 1, False))
            for start, end, t, confirmed, alone, gain, rank, later in sorted(mine):
                missing, put = wording(templates[t][1], text[start:end])
                out.append((row, start, end, templates[t][0], confirmed, alone, gain, rank, later, " ".join(missing), " ".join(put), text[start:end]))
        ids = batch.column("doc_id").take(pa.array([r[0] for r in out], pa.int64()))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([ids, *(pa.array([r[i + 1] for r in out], k) for i, k in enumerate(kinds))], ["doc_id", "start", "end", "license", "confirmed", "plain_bytes", "gain_bytes", "rank", "or_later", "missing", "added", "block_text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_texts(docs.select("doc_id", "text"), "text", work, f"doc_id {kind}, start bigint, end bigint, license string, confirmed boolean, plain_bytes bigint, gain_bytes bigint, rank int, or_later boolean, missing string, added string, block_text string")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
