"""License scan by conditional compression: which template explains a block of text best."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import cache

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postvet.llm.common import map_texts, ready

# Common license notices and texts, as their licenses word them. List numbers
# are left out, as texts have bullets in their place too.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software."
    ),
    "mit-whole": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", "
        "WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, "
        "TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
        "IN THE SOFTWARE."
    ),
    "isc-whole": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all "
        "copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS "
        "SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR "
        "BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
        "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
        "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0"
    ),
    "apache-2.0-header-whole": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License."
    ),
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version."
    ),
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-2.0-header": (
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU "
        "General Public License as published by the Free Software Foundation; either version 2 of the License, "
        "or (at your option) any later version."
    ),
    "lgpl-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "lgpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "Lesser General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version."
    ),
    "lgpl-2.1-notice": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "lgpl-2.1-header": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
        "Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the "
        "License, or (at your option) any later version."
    ),
    "agpl-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "agpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
        "Affero General Public License as published by the Free Software Foundation, either version 3 of the "
        "License, or (at your option) any later version."
    ),
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
        "MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "bsd-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met:"
    ),
    "bsd-2-clause-whole": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE "
        "COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
        "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
        "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
        "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED "
        "AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
        "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF "
        "SUCH DAMAGE."
    ),
    "bsd-3-clause-whole": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution. Neither the name of the "
        "copyright holder nor the names of its contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE "
        "COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT "
        "LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
        "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, "
        "INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF "
        "SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED "
        "AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
        "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF "
        "SUCH DAMAGE."
    ),
    "unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-nd-4.0-notice": "Licensed under CC BY-ND 4.0.",
    "cc0-1.0-notice": "Released under CC0 1.0.",
}
# A template is looked for where one of its anchors stands, these words first (see `_anchors`).
ANCHORS = ("license", "licensed", "released", "permission", "redistribution", "redistribute")
# Words that tell one license from another; they may be neither replaced, left out nor added.
FAMILY = frozenset(
    "affero apache cc gnu lesser library mit mozilla mpl nc nd noncommercial noderivatives sa sharealike".split()
)
MAX_DIFFERENCE = 0.1   # share of the template's words that may differ
MIN_GAIN = 0.3         # share of the compressed size that the template must save
SLACK = 2              # words more than the template that a block may hold at its end


WORDS = regex.compile(r"[^\x20\x09-\x0D]+")
NAMES = regex.compile(r"[\p{L}\p{N}.\-/]*[\p{L}\p{N}]")
SCHEME = regex.compile(r"https?://(?:www\.)?")


@dataclass(frozen=True)
class Match:
    license: str
    start: int
    gain: float
    missing: list[str]
    extra: list[str]


def _plain(word: str) -> str:
    """Lower case, without outer punctuation; inner signs as in CC BY-NC or 2.0 stay."""
    found = NAMES.search(SCHEME.sub("", word.lower()) if "://" in word else word.lower())
    return found.group() if found else ""


def _anchors(words: list[str], spread: Counter) -> list[str]:
    """Words of which any block within MAX_DIFFERENCE holds one unchanged.

    A word that may not differ is enough. Otherwise one word more than may differ, words
    that many templates have (`spread`) before others.
    """
    may = int(MAX_DIFFERENCE * len(words))
    known = [a for a in ANCHORS if a in words]
    fixed = [w for w in words if _names(w)]
    if may and fixed:
        return [max(fixed, key=len)]
    others = sorted(set(words) - set(known), key=lambda w: (len(w) < 7, -spread[w], -len(w), w))
    return (known + others)[:may + 1]


@dataclass(frozen=True)
class Template:
    name: str
    words: list[str]
    bag: Counter
    may: int
    packer: zstandard.ZstdCompressor


class Scanner:
    """Templates with their dictionaries; built once in each worker."""

    def __init__(self, templates: dict[str, str], level: int = 3):
        self.templates: list[Template] = []
        self.anchors: dict[str, list[tuple[Template, int]]] = {}
        for name, text in sorted(templates.items()):
            words = [w for w in map(_plain, WORDS.findall(text)) if w]
            raw = zstandard.ZstdCompressionDict(" ".join(words).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=level)
            packer = zstandard.ZstdCompressor(level=level, dict_data=raw, write_content_size=False)
            self.templates.append(Template(name, words, Counter(words), int(MAX_DIFFERENCE * len(words)), packer))
        spread = Counter(w for t in self.templates for w in t.bag)
        for template in self.templates:
            for anchor in _anchors(template.words, spread):
                places = [i for i, w in enumerate(template.words) if w == anchor]
                self.anchors.setdefault(anchor, []).extend((template, at) for at in places)
        self.alone = zstandard.ZstdCompressor(level=level, write_content_size=False)
        self.find = regex.compile(r"(?<![\p{L}\p{N}])(?:" + "|".join(map(regex.escape, sorted(self.anchors))) + r")(?![\p{L}\p{N}])", regex.I)

    def ranked(self, block: list[str]) -> list[tuple[int, float, Template]]:
        """(bytes saved, share saved, template) of all templates as dictionary of the block, best first.

        Templates that save the same are ordered by their length's distance from the block's.
        """
        body = " ".join(block).encode()
        plain = len(self.alone.compress(body))
        saved = [(plain - len(t.packer.compress(body)), t) for t in self.templates]
        saved.sort(key=lambda s: (-s[0], abs(len(s[1].words) - len(block)), s[1].name))
        return [(n, n / plain, t) for n, t in saved]

    def blocks(self, words: list[str]) -> set[tuple[int, int]]:
        """(start, size) of the blocks to compress: around anchors, with enough words of a template."""
        found, tried = set(), set()
        for at, word in enumerate(words):
            for template, offset in self.anchors.get(word, ()):
                size, may = len(template.words), template.may
                # Words missing or added before the anchor move the start.
                for start in range(max(0, at - offset - may), max(0, at - offset + may) + 1):
                    if (template.name, start) not in tried:
                        tried.add((template.name, start))
                        if _holds(template, words, start):
                            found.add((start, size))
        return found

    def scan(self, text: str | None) -> list[Match]:
        """Confirmed notices of a whole text in order; of overlapping ones the one that saves most."""
        if not text or not self.find.search(text):
            return []
        # Comment signs and other words without a letter or digit don't count, but in `start`.
        places, words = [], []
        for place, word in enumerate(WORDS.findall(text)):
            if plain := _plain(word):
                places.append(place)
                words.append(plain)
        # Of the blocks of one template that overlap, the fewest differences and then the gain tell where it starts.
        aligned: dict[str, list[tuple]] = {}
        for start, size in sorted(self.blocks(words)):
            for saved, gain, template in self.ranked(words[start:start + size]):
                if gain < MIN_GAIN:
                    break
                confirmed = _confirmed(template, words, start)
                if confirmed is not None:
                    missing, extra = confirmed
                    aligned.setdefault(template.name, []).append(
                        (len(missing) + len(extra), -saved, start, gain, len(template.words), missing, extra)
                    )
                    break
        found = []
        for name, rows in aligned.items():
            taken: set[int] = set()
            for _, saved, start, gain, size, missing, extra in sorted(rows, key=lambda r: r[:3]):
                if not taken.isdisjoint(range(start, start + size)):
                    continue
                taken.update(range(start, start + size))
                found.append((saved, len(missing) + len(extra), name, start, gain, size, missing, extra))
        kept: list[Match] = []
        taken = set()
        for _, _, name, start, gain, size, missing, extra in sorted(found, key=lambda f: f[:4]):
            if taken.isdisjoint(range(start, start + size)):
                taken.update(range(start, start + size))
                kept.append(Match(name, places[start], gain, missing, extra))
        return sorted(kept, key=lambda m: m.start)


def _near(template: Template, words: list[str], start: int) -> list[str]:
    return words[start:start + len(template.words) + max(SLACK, template.may)]


def _holds(template: Template, words: list[str], start: int) -> bool:
    """Whether so few of the template's words are missing that it can be confirmed."""
    lacks = template.bag - Counter(_near(template, words, start))
    return sum(lacks.values()) <= template.may


def _confirmed(template: Template, words: list[str], start: int) -> tuple[list[str], list[str]] | None:
    """(missing, extra) words of the block against the template, None if the wording differs too much."""
    if not _holds(template, words, start):
        return None
    near, size = _near(template, words, start), len(template.words)
    found = [differences(template.words, near[:size + s]) for s in sorted({SLACK, max(SLACK, template.may)})]
    missing, extra, clear = min(found, key=lambda d: len(d[0]) + len(d[1]))
    return (missing, extra) if clear and len(missing) + len(extra) <= MAX_DIFFERENCE * size else None


def _names(word: str) -> bool:
    """Whether a word names a license or a version."""
    return any(c.isdigit() for c in word) or word in FAMILY or word.startswith("by-")


def differences(wanted: list[str], block: list[str]) -> tuple[list[str], list[str], bool]:
    """Words of the template that the block lacks, words that it has beside them, and
    whether none of these makes it another license.

    What follows the last agreeing word is not part of the notice. A number that is only
    added (such as a line number) is no version.
    """
    missing, extra, clear = [], [], True
    steps = SequenceMatcher(None, wanted, block, autojunk=False).get_opcodes()
    for i, (kind, a, b, c, d) in enumerate(steps):
        if kind == "equal":
            continue
        missing += wanted[a:b]
        clear &= not any(map(_names, wanted[a:b]))
        if i < len(steps) - 1:
            extra += block[c:d]
            clear &= not any(w.startswith("by-") or not FAMILY.isdisjoint(regex.split(r"[-/]", w)) for w in block[c:d])
            clear &= kind != "replace" or not any(map(_names, block[c:d]))
    return missing, extra, clear


@cache
def _scanner(items: tuple) -> Scanner:
    return Scanner(dict(items))


def scan_licenses(
    docs: DataFrame, templates: dict[str, str] | None = None, key: str = "doc_id", text: str = "text",
) -> DataFrame:
    """(key, license, start, gain, missing, extra): the confirmed license notices of every row.

    Blocks of each template's size are cut around each place where one of its anchor words
    stands, at every start that a tenth of differing words allows. Words without a letter
    or digit, such as comment signs, are left out first. A block that holds enough words
    of a template is compressed with every template as zstandard raw dictionary. The
    templates are ranked by the bytes saved (30 % at least), and the first one is named of
    which at most a tenth of the words differ, none of them a word or number that tells
    licenses apart; numbers may be added. Overlapping blocks of one template: the one with
    fewest differences stays. Of overlapping notices the one that saves most bytes stays.
    `start` is the word it begins at, all words counted; `missing` and `extra` are the
    differing words.

    Anchors are looked for in the whole text; texts without one are left out by a byte
    search before Python. Null and empty texts have no notice. Repeated rows are
    reported each. Empty tables give no rows. Other columns are not looked at.
    """
    ready(docs.sparkSession)
    items = tuple(sorted((TEMPLATES if templates is None else templates).items()))
    anchors = sorted(Scanner(dict(items)).anchors)
    body = F.lower(F.col(text))
    some = None
    for anchor in anchors:
        hit = body.contains(anchor)
        some = hit if some is None else some | hit

    def work(texts):
        found = [_scanner(items).scan(t) for t in texts]
        text_list = pa.list_(pa.list_(pa.string()))
        return [pa.array([[m.license for m in f] for f in found], pa.list_(pa.string())),
                pa.array([[m.start for m in f] for f in found], pa.list_(pa.int64())),
                pa.array([[m.gain for m in f] for f in found], pa.list_(pa.float64())),
                pa.array([[m.missing for m in f] for f in found], text_list),
                pa.array([[m.extra for m in f] for f in found], text_list)]

    made = map_texts(
        docs.filter(some), [key], text,
        "license array<string>, start array<bigint>, gain array<double>, "
        "missing array<array<string>>, extra array<array<string>>", work,
    )
    return made.select(key, F.explode(F.arrays_zip("license", "start", "gain", "missing", "extra")).alias("m")).select(
        key, "m.license", "m.start", "m.gain", "m.missing", "m.extra"
    )
