"""License scan: winnowed template fingerprints pick candidates, banded alignment measures them.

Templates (notices and short texts of common licenses) are cut into grams of
``GRAM`` words; of every ``WINDOW`` consecutive grams the one with the smallest
hash (of those within the license's name, if there are any) goes into an
inverted index (winnowing), so any ``GRAM + WINDOW - 1`` words that a text
shares with a template hit the index.  All grams of a document are looked up.
Hits of a template whose diagonals (place in the document minus place in the
template) lie within the band are one candidate; a banded sequence alignment
of the template with the words around it gives the matched words and the
span.  The alignments of a text are made together, equal ones once, their
bands filled row by row as whole arrays.  The words that tell a license from
its siblings (``EXACT``: name, kind, version) must be there as they stand, with
no word that changes them beside them; otherwise the finding is only similar
and names no license.  What is below ``MIN_COVERAGE`` is reported by its parts:
local alignments of ``PART_WORDS`` matched words or more.  Of overlapping
findings whole ones go before similar ones and these before parts, then the one
with the most matched words.  After the tag of a license expression each further
license of the expression is a finding of its own.

The templates are a small fixed list, sent with the tasks; the scan is one
pass without a shuffle.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from kestrel.llm.common import slices, text_bytes
from kestrel.llm.decontaminate import _TABLE, _runs, words_of

GRAM, WINDOW = 3, 3
BAND = 8                   # words an alignment may run ahead or behind (a quarter of a shorter template)
MIN_COVERAGE = 0.8

PART_WORDS = GRAM + WINDOW - 1    # matched words from which a part of a template is reported
KINDS = ("whole", "similar", "part")
ALIGN_PAIRS, ALIGN_CELLS = 4096, 1 << 19      # pairs aligned at a time, and words of their windows

_FAR, _MATCH = 1 << 40, 1 << 32
_OUTSIDE, _TAKEN = -3, -2

_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: ")
_BSD_CLAUSES = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution. ")

_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
    "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_ISC_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
    "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
    "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN "
    "ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF "
    "THIS SOFTWARE.")
_BSD_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
    "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
    "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN "
    "CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")

# Short notices (four wordings), and notices as the licenses publish them.  A wording's number after #
# is not part of the license's name.
TEMPLATES = {
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    "BSD-2-Clause": _BSD + _BSD_CLAUSES,
    "BSD-3-Clause": _BSD + _BSD_CLAUSES + (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
        "products derived from this software without specific prior written permission."),
    "BSD-3-Clause#2": _BSD + _BSD_CLAUSES + (
        "The name of the author may not be used to endorse or promote products derived from this software without "
        "specific prior written permission."),
    "BSD-4-Clause": _BSD + _BSD_CLAUSES + (
        "All advertising materials mentioning features or use of this software must display the following "
        "acknowledgement: This product includes software developed by the copyright holder. Neither the name of the "
        "copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission."),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "0BSD": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted."),
    "MPL-1.1": (
        "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use "
        "this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.mozilla.org/MPL/"),
}
# Whole texts of the short licenses.
_BSD_3 = (" Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
          "derived from this software without specific prior written permission. ")
TEMPLATES |= {
    "MIT#2": TEMPLATES["MIT"] + (
        ": The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
        "the Software. ") + _AS_IS,
    "ISC#2": TEMPLATES["ISC"] + " " + _ISC_AS_IS,
    "0BSD#2": TEMPLATES["0BSD"] + " " + _ISC_AS_IS,
    "BSD-2-Clause#2": _BSD + _BSD_CLAUSES + _BSD_AS_IS,
    "BSD-3-Clause#3": _BSD + _BSD_CLAUSES + _BSD_3 + _BSD_AS_IS,
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
        "for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the "
        "following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you "
        "wrote the original software. If you use this software in a product, an acknowledgment in the product documentation "
        "would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not "
        "be misrepresented as being the original software. 3. This notice may not be removed or altered from any source "
        "distribution."),
    "BSL-1.0": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, "
        "execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to "
        "whom the Software is furnished to do so"),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means."),
}
# Words that must be there exactly, by wording.
EXACT = {
    "MIT-line": ["MIT License"], "Apache-2.0-line": ["Apache License, Version 2.0"],
    "GPL-3.0-line": ["GNU General Public License, version 3"], "CC-BY-NC-4.0-line": ["CC BY-NC 4.0"],
    "Apache-2.0": ["Apache License, Version 2.0"], "MPL-2.0": ["Mozilla Public License, v. 2.0"],
    "MPL-1.1": ["Mozilla Public License Version 1.1"], "ISC": ["provided that the above copyright notice"],
    "0BSD": ["with or without fee is hereby granted"],
    "ISC#2": ["provided that the above copyright notice"], "0BSD#2": ["hereby granted the software is provided as is"],
    "BSD-2-Clause#2": ["Redistributions in binary form must reproduce the above copyright notice"],
    "BSD-3-Clause#3": ["nor the names of its contributors may be used to endorse or promote products"],
    "BSL-1.0": ["any person or organization obtaining a copy"], "Unlicense": ["released into the public domain"],
    "BSD-2-Clause": ["Redistributions in binary form must reproduce the above copyright notice"],
    "BSD-3-Clause": ["nor the names of its contributors may be used to endorse or promote products"],
    "BSD-3-Clause#2": ["may not be used to endorse or promote products"],
    "BSD-4-Clause": ["All advertising materials mentioning features or use of this software",
                     "may be used to endorse or promote products"],
}
# Words near a finding that make it another license: (words looked at after its end, runs).
OTHERWISE = {"BSD-2-Clause": (80, ["endorse or promote products", "all advertising materials"]),
             "BSD-3-Clause": (20, ["all advertising materials"]), "BSD-3-Clause#2": (20, ["all advertising materials"]),
             "BSD-2-Clause#2": (80, ["endorse or promote products", "all advertising materials"]),
             "BSD-3-Clause#3": (20, ["all advertising materials"]), "0BSD": (3, ["provided that"])}
# Beside exact words, these change the license.
MODIFIERS = frozenset(b"lesser library affero nc sa nd noncommercial sharealike noderivatives noderivs non share no igo".split())


# License of each name in an SPDX tag, lower-cased.
SPDX: dict[str, str] = {}


def _short_notices() -> None:
    """Short notices of the common licenses and their siblings, and the GNU notices, into TEMPLATES and EXACT."""
    def add(license: str, text: str, *exact: str) -> None:
        n = next(n for n in range(1, 1000) if (f"{license}#{n}" if n > 1 else license) not in TEMPLATES)
        name = f"{license}#{n}" if n > 1 else license
        TEMPLATES[name], EXACT[name] = text, list(exact)

    names = {"MIT": ["MIT License"], "ISC": ["ISC License"], "Unlicense": ["Unlicense"], "0BSD": ["Zero-Clause BSD License"],
             "Apache-1.1": ["Apache License, Version 1.1", "Apache Software License, Version 1.1"],
             "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"],
             "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"],
             "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License"],
             "BSD-4-Clause": ["BSD 4-Clause License", "4-Clause BSD License"],
             "MPL-1.1": ["Mozilla Public License, Version 1.1"],
             "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License, v. 2.0", "Mozilla Public License 2.0"],
             "EPL-1.0": ["Eclipse Public License, Version 1.0", "Eclipse Public License 1.0"],
             "EPL-2.0": ["Eclipse Public License, Version 2.0", "Eclipse Public License v2.0", "Eclipse Public License 2.0"],
             "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"], "Zlib": ["zlib License"],
             "EUPL-1.1": ["European Union Public Licence, Version 1.1", "European Union Public Licence v. 1.1", "EUPL, Version 1.1"],
             "EUPL-1.2": ["European Union Public Licence, Version 1.2", "European Union Public Licence v. 1.2", "EUPL, Version 1.2"],
             "Artistic-2.0": ["Artistic License 2.0", "Artistic License, Version 2.0"],
             "CDDL-1.0": ["Common Development and Distribution License, Version 1.0", "CDDL 1.0"],
             "CC0-1.0": ["CC0 1.0", "Creative Commons Zero 1.0"]}
    for short, words in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"),
                         ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
                         ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            names[f"CC-{short}-{v}"] = [f"CC {short} {v}", f"Creative Commons {words} {v}"]
            if short.endswith("ND"):
                names[f"CC-{short}-{v}"].append(f"Creative Commons {words.replace('Derivatives', 'Derivs')} {v}")
    add("public-domain-line", "released into the public domain", "into the public domain")
    add("public-domain-line", "placed in the public domain", "in the public domain")
    later = ("or later", "or any later version", "or (at your option) any later version")
    for letter, kind, versions in (("", "", ("1", "2", "3")), ("L", "Library ", ("2",)), ("L", "Lesser ", ("2.1", "3")),
                                   ("A", "Affero ", ("3",))):
        for v in versions:
            license, long = f"{letter}GPL-{v}" + ("" if "." in v else ".0"), f"GNU {kind}General Public License"
            either = [f"{long}, version {v}", f"{long} v{v}", f"GNU {letter}GPL version {v}", f"{letter}GPL version {v}",
                      f"GNU {letter}GPLv{v}", f"{letter}GPLv{v}", f"{letter}GPL {v}"]
            names[license] = [*either, f"{long} {v}"] + [f"{long} {v}.0", f"{letter}GPL {v}.0"] * ("." not in v)
            add(f"{license}-line", f"under the terms of version {v} of the {long}", f"version {v} of the {long}")
            names[f"{license}-or-later"] = [f"{n} {x}" for n in either for x in later]
            # The notices that the GNU licenses publish.
            subject = "library" if letter == "L" else "program"
            for mark in (";", ":"):
                add(f"{license}-or-later", f"This {subject} is free software{mark} you can redistribute it and/or modify it under "
                    f"the terms of the {long} as published by the Free Software Foundation, either version {v} of the License, "
                    "or (at your option) any later version.", long, f"version {v} of the License", "any later version")
    for license, texts in names.items():
        for text in texts:
            add(f"{license}-line", f"under the {text}", text)
            if len(words_of(text.encode())) <= 2:
                # Two words more are too many for so short a notice.
                add(f"{license}-line", f"under the terms of the {text}", text)
            if license.startswith("CC") or len(words_of(text.encode())) == 1:
                add(f"{license}-line", f"Licensed under {text}", text)
        spdx = [license, f"{license}-only"] if "GPL" in license and "later" not in license else [license]
        for x in spdx:
            add(f"{license}-line", f"SPDX-License-Identifier: {x}", f"Identifier: {x}")
            SPDX[x.lower()] = f"{license}-line"


_short_notices()


def winnow(hashes: list, window: int = WINDOW) -> set[int]:
    """Positions of the smallest hash (the rightmost of equal ones) in every ``window`` consecutive hashes."""
    if len(hashes) <= window:
        return {min(range(len(hashes)), key=lambda i: (hashes[i], -i))} if hashes else set()
    return {min(range(i, i + window), key=lambda j: (hashes[j], -j)) for i in range(len(hashes) - window + 1)}


def align_many(templates: list[np.ndarray], windows: list[np.ndarray], shifts: list[int], band: int,
               part: bool = False) -> list[tuple[int, int, int]]:
    """Best alignment of each template with a run of its window near the diagonal word = place + shift.

    A match counts 1, a gap or mismatch -1; words before and after the run are
    free.  With ``part`` the run of the template is free as well, and begins
    and ends with a match.  Gives (matched template words, first word, end) of
    each.  Bands of many pairs are filled row by row as whole arrays, short templates first.
    """
    out: list[tuple[int, int, int]] = [(0, 0, 0)] * len(templates)
    order = sorted(range(len(templates)), key=lambda c: len(templates[c]))
    while order:
        most = len(templates[order[min(len(order), ALIGN_PAIRS) - 1]])
        n = max(1, min(len(order), ALIGN_PAIRS, ALIGN_CELLS // (most + 2 * band + 1)))
        some, order = order[:n], order[n:]
        for c, best in zip(some, _align_rows([templates[c] for c in some], [windows[c] for c in some],
                                             [shifts[c] for c in some], band, part), strict=True):
            out[c] = best
    return out


def _align_rows(templates: list[np.ndarray], windows: list[np.ndarray], shifts: list[int], band: int,
                part: bool) -> list[tuple[int, int, int]]:
    """``align_many`` of some pairs, sorted by the length of the template."""
    width, sizes = 2 * band + 1, np.array([len(t) for t in templates])
    n, rows = len(sizes), int(sizes[-1])
    t = np.full((n, rows), _OUTSIDE, np.int64)
    x = np.full((n, rows + width), _OUTSIDE, np.int64)      # cell k of row i stands for word x[i + k]
    for c, (template, words, shift) in enumerate(zip(templates, windows, shifts, strict=True)):
        t[c, :len(template)] = template
        lo, hi = max(0, shift - band), min(len(words), shift - band + x.shape[1])
        if lo < hi:
            x[c, lo - shift + band:hi - shift + band] = words[lo:hi]
    k = np.arange(width)
    score, path = np.zeros((n, width), np.int64), np.zeros((n, width), np.int64)      # path: matches and first word
    edge = np.full((n, 1), 0 if part else -_FAR)
    best_score, best_path, best_end = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    from_row = 0
    for i in range(rows):
        done = int(np.searchsorted(sizes, i, "right"))      # pairs whose template is over
        score, path = score[done - from_row:], path[done - from_row:]
        from_row = done
        word = x[done:, i:i + width]
        hit = word == t[done:, i:i + 1]
        # Place i is skipped, or it meets the word, or (last) words before are skipped.
        cell = np.concatenate([score[:, 1:], edge[done:]], axis=1) - 1
        cell_path = np.concatenate([path[:, 1:], np.zeros_like(path[:, :1])], axis=1)
        meet = np.where(hit, score + 1, score - 1)
        better = (word != _OUTSIDE) & (meet > cell)
        meet_path = np.where(path < _MATCH, i + k, path) + hit * _MATCH
        cell, cell_path = np.where(better, meet, cell), np.where(better, meet_path, cell_path)
        if part:
            top = np.where(hit & better, cell, 0)
            at = top.argmax(axis=1)
            r = np.arange(len(at))
            up = top[r, at] > best_score[done:]
            best_score[done:][up], best_path[done:][up], best_end[done:][up] = (
                top[r, at][up], cell_path[r, at][up], i + at[up] + 1)
        level = cell + k
        high = np.maximum.accumulate(level, axis=1)
        origin = np.maximum.accumulate(np.where(level == high, k, 0), axis=1)
        score, path = high - k, np.take_along_axis(cell_path, origin, axis=1)
        if part:
            path, score = np.where(score > 0, path, 0), np.maximum(score, 0)
        else:
            over = int(np.searchsorted(sizes, i + 1, "right")) - done
            if over:
                top = np.where(path[:over] >= _MATCH, score[:over], -2 * _FAR)
                at = top.argmax(axis=1)
                r = np.arange(over)
                best_score[done:done + over], best_path[done:done + over] = top[r, at], path[r, at]
                best_end[done:done + over] = i + 1 + at
    out = []
    for c, (p, end) in enumerate(zip(best_path.tolist(), best_end.tolist(), strict=True)):
        m, first = p // _MATCH, p % _MATCH + shifts[c] - band
        out.append((m, first, min(max(end + shifts[c] - band, first + 1), len(windows[c]))) if m else (0, 0, 0))
    return out


class _Page:
    """A text, its words and their numbers; places of runs of words, each found once."""

    def __init__(self, text: bytes, words: list[bytes], ids: np.ndarray):
        self.text, self.words, self.ids = text, words, ids
        self._places: dict[bytes, np.ndarray] = {}
        self._standing: dict[bytes, np.ndarray] = {}
        self._ends: np.ndarray | None = None

    def span(self, word: int) -> tuple[int, int]:
        """Bytes [begin, end) of a word."""
        if self._ends is None:
            blank = np.frombuffer(b" " + self.text.translate(_TABLE) + b" ", np.uint8) == 32
            self._begins = np.flatnonzero(blank[:-1] & ~blank[1:])
            self._ends = np.flatnonzero(~blank[:-1] & blank[1:])
        return int(self._begins[word]), int(self._ends[word])

    def word_at(self, byte: int) -> int:
        """The first word that begins at ``byte`` or later."""
        self.span(0)
        return int(np.searchsorted(self._begins, byte))

    def places(self, run: np.ndarray) -> np.ndarray:
        """Where ``run`` stands, ascending."""
        key = run.tobytes()
        if key not in self._places:
            at = np.flatnonzero(self.ids[:max(0, len(self.ids) - len(run) + 1)] == run[0])
            for i in range(1, len(run)):
                at = at[self.ids[at + i] == run[i]]
            self._places[key] = at
        return self._places[key]

    def standing(self, run: np.ndarray) -> np.ndarray:
        """Where ``run`` stands and nothing beside it makes it another license."""
        key = run.tobytes()
        if key not in self._standing:
            self._standing[key] = np.array([at for at in self.places(run).tolist() if self._plain(at, at + len(run))], np.int64)
        return self._standing[key]

    def _plain(self, at: int, stop: int) -> bool:
        if MODIFIERS.intersection(self.words[max(0, at - 1):at] + self.words[stop:stop + 1]):
            return False
        end = self.span(stop - 1)[1]
        return not _GOES_ON.match(self.text[end:end + 2])


def _within(places: np.ndarray, lo: int, hi: int) -> bool:
    """Whether a place lies in [lo, hi]."""
    i = int(np.searchsorted(places, lo))
    return i < len(places) and int(places[i]) <= hi


class TemplateIndex:
    """Numbered template words and the inverted index of their winnowed grams."""

    def __init__(self, templates: dict[str, str]):
        self.number: dict[bytes, int] = {}
        self.names = list(templates)
        self.words = [np.array([self.number.setdefault(w, len(self.number)) for w in words_of(t.encode())], np.int64)
                      for t in templates.values()]
        numbers = lambda text: np.array([self.number.setdefault(w, len(self.number)) for w in words_of(text.encode())], np.int64)
        own = [EXACT.get(n, []) if TEMPLATES.get(n) == t else [] for n, t in templates.items()]
        self.exact = [[numbers(x) for x in e] for e in own]
        other = [OTHERWISE.get(n, (0, [])) if TEMPLATES.get(n) == t else (0, []) for n, t in templates.items()]
        self.otherwise = [(reach, [numbers(x) for x in runs]) for reach, runs in other]
        self.band = [min(BAND, max(1, len(w) // 4)) for w in self.words]
        entries = []
        for t, ids in enumerate(self.words):
            grams = [self._code(ids[i:i + GRAM]) for i in range(len(ids) - GRAM + 1)]
            # Grams within the words that tell licenses apart go first, so that a short notice is found by its name.
            name = {self._code(run[i:i + GRAM]) for run in self.exact[t] for i in range(len(run) - GRAM + 1)}
            for i in winnow([(g not in name, xxhash.xxh64_intdigest(g.to_bytes(8, "little"))) for g in grams]):
                entries.append((grams[i], t, i))
        entries.sort()
        self.grams = np.array([e[0] for e in entries], np.int64)
        self.entry_template = np.array([e[1] for e in entries], np.int64)
        self.entry_place = np.array([e[2] for e in entries], np.int64)
        self.word_list = [w.tolist() for w in self.words]
        tag = [self.number.get(w, -1) for w in words_of(b"SPDX-License-Identifier")]
        self.tag = np.array(tag if min(tag) >= 0 else [], np.int64)

    @staticmethod
    def _code(ids) -> int:
        code = 0
        for x in ids:
            code = code << 20 | int(x)
        return code

    def candidates(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """(template, diagonal) of each group of hits."""
        n = len(ids) - GRAM + 1
        if n <= 0:
            return []
        ok = np.flatnonzero((ids[:n] >= 0) & (ids[1:n + 1] >= 0) & (ids[2:n + 2] >= 0))
        code = ids[ok] << 40 | ids[ok + 1] << 20 | ids[ok + 2]
        lo, hi = np.searchsorted(self.grams, code, "left"), np.searchsorted(self.grams, code, "right")
        entry = _runs(lo[lo < hi], (hi - lo)[lo < hi])
        if not len(entry):
            return []
        t, d = self.entry_template[entry], np.repeat(ok, hi - lo) - self.entry_place[entry]
        order = np.lexsort((d, t))
        groups, last, reach = [], -1, 0
        for t, d in zip(t[order].tolist(), d[order].tolist(), strict=True):
            if t != last or d > reach:
                last, reach = t, d + self.band[t]
                groups.append((t, d))
        return groups

    def aligned(self, pairs: list[tuple[int, int, int, int]], ids: np.ndarray, part: bool) -> list[tuple[int, int, int]]:
        """Alignments of (template, diagonal, lo, hi): matched words, first word, end in the text.  What reads the
        same words by the same template is aligned once."""
        place: dict[tuple, int] = {}
        distinct: list[tuple[int, int, np.ndarray]] = []
        which = []
        for t, d, lo, hi in pairs:
            window = ids[lo:hi]
            key = (t, d - lo, window.tobytes())
            if key not in place:
                place[key] = len(distinct)
                distinct.append((t, d - lo, window))
            which.append(place[key])
        best: list[tuple[int, int, int]] = [(0, 0, 0)] * len(distinct)
        bands: dict[int, list[int]] = {}
        for c, (t, _, _) in enumerate(distinct):
            bands.setdefault(self.band[t], []).append(c)
        for band, some in bands.items():
            got = align_many([self.words[distinct[c][0]] for c in some], [distinct[c][2] for c in some],
                             [distinct[c][1] for c in some], band, part)
            for c, b in zip(some, got, strict=True):
                best[c] = b
        return [(best[c][0], lo + best[c][1], lo + best[c][2]) for c, (_, _, lo, _) in zip(which, pairs, strict=True)]

    def findings(self, text: bytes) -> list[tuple[str | None, str, str, int, float, int, int]]:
        """Findings of a text: (license or None, template, kind, matched words, coverage, first word, end)."""
        words = words_of(text)
        get = self.number.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        groups = self.candidates(ids)
        if not groups:
            return []
        page = _Page(text, words, ids)
        pairs, rest = [], []
        known: dict[tuple[int, bytes], int] = {}
        for t, d in groups:
            lo, hi = max(0, d - self.band[t]), d + len(self.words[t]) + 2 * self.band[t]
            # What can't match enough words needs no alignment.
            key = (t, ids[lo:hi].tobytes())
            most = known.get(key)
            if most is None:
                most = known[key] = sum(map(set(ids[lo:hi].tolist()).__contains__, self.word_list[t]))
            if most >= MIN_COVERAGE * len(self.words[t]):
                pairs.append((t, d, lo, hi))
            elif most >= PART_WORDS:
                rest.append((t, d, lo, hi))
        found = []
        for pair, (m, first, end) in zip(pairs, self.aligned(pairs, ids, part=False), strict=True):
            t = pair[0]
            if m >= MIN_COVERAGE * len(self.words[t]):
                good = self.named(t, page, first, end)
                found.append((0 if good else 1, m, m / len(self.words[t]), first, end, t, good))
            else:
                rest.append(pair)
        kept: list[tuple] = []
        taken = np.zeros(len(words), bool)

        def keep(found: list[tuple]) -> None:
            for f in sorted(found, key=lambda f: (f[0], -f[1], not f[6], -f[2], f[3], f[5])):
                if not taken[f[3]:f[4]].any():
                    taken[f[3]:f[4]] = True
                    kept.append(f)
        keep(found)
        while rest:        # the parts of what is left, the longest first, until none is found
            found, again = [], []
            free = np.where(taken, _TAKEN, ids)
            known_before = np.concatenate([[0], np.cumsum(free >= 0)])
            at = np.minimum(np.array(rest, np.int64)[:, 2:], len(free))
            enough = known_before[at[:, 1]] - known_before[at[:, 0]] >= PART_WORDS
            rest = [p for p, e in zip(rest, enough.tolist(), strict=True) if e]
            for pair, (m, first, end) in zip(rest, self.aligned(rest, free, part=True), strict=True):
                t = pair[0]
                if m >= PART_WORDS and not taken[first:end].any():
                    good = self.named(t, page, first, end)
                    found.append((2, m, m / len(self.words[t]), first, end, t, good))
                    again.append(pair)
            keep(found)
            rest = again
        out = [(self.names[t].split("#")[0] if good else None, self.names[t], KINDS[k], m, c, first, end)
               for k, m, c, first, end, t, good in kept]
        return sorted(out + self.expressions(page, taken), key=lambda f: f[5:])

    def named(self, t: int, page: _Page, first: int, end: int) -> bool:
        """Whether the words [first, end) hold the template's exact words, nothing beside them that changes them."""
        reach, runs = self.otherwise[t]
        return (all(_within(page.standing(run), first, end - len(run)) for run in self.exact[t])
                and not any(_within(page.places(run), end, end + reach - len(run)) for run in runs))

    def expressions(self, page: _Page, taken: np.ndarray) -> list[tuple]:
        """The further licenses of license expressions whose tag stands in a finding: a finding for each name after
        an operator ("similar" if no template has the name); what follows WITH is an exception, not a license."""
        out = []
        tag = self.tag
        for at in page.places(tag).tolist() if len(tag) else ():
            if not taken[at]:
                continue
            begin = page.span(at + len(tag) - 1)[1]
            m = _EXPRESSION.match(page.text, begin)
            for x in _FURTHER.finditer(m[0]) if m else ():
                if x[1] == b"WITH":
                    continue
                first, end = page.word_at(begin + x.start(2)), page.word_at(begin + x.end(2))
                if first < end and not taken[first:end].any():
                    taken[first:end] = True
                    name = x[2].decode().lower()
                    license = SPDX.get(name[:-1] + "-or-later" if name.endswith("+") else name)
                    out.append((license, "SPDX-License-Identifier", KINDS[0 if license else 1], end - first, 1.0, first, end))
        return out

    def scan(self, text: bytes) -> list[tuple[str, int, float, int, int]]:
        """Whole notices of a text: (license, matched words, coverage, first word, end)."""
        return [(name, m, c, first, end) for name, _, kind, m, c, first, end in self.findings(text) if kind == "whole"]


_EXPRESSION = re.compile(rb"[: (]+[A-Za-z0-9.+-]+(?:[ )]+(?:AND|OR|WITH)[ (]+[A-Za-z0-9.+-]+)+")
_FURTHER = re.compile(rb"[ )]+(AND|OR|WITH)[ (]+([A-Za-z0-9.+-]+)")
_GOES_ON = re.compile(rb"[.\-][0-9]|\+")        # after exact words: another version


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """License notices in every whole text, a row for each: doc_id, license, template, kind, matched_words, coverage
    (of the template, 0 to 1), first_word, last_word (exclusive), first_char, last_char (exclusive, in code points).

    ``kind``: "whole" (coverage from ``MIN_COVERAGE``), "similar" (as much, but the words that tell licenses apart
    differ) or "part" (less).  ``license`` is NULL where these words aren't there as the template has them.

    Texts without notices (NULL and empty ones among them) give no row; a
    notice that a text repeats is reported each time; repeated rows repeat
    their findings; templates without words never match.
    """
    index = TemplateIndex(templates if templates is not None else TEMPLATES)

    def run(batches):
        kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.float64(), pa.int64(), pa.int64(), pa.int64(),
                 pa.int64())
        names = ["doc_id", "license", "template", "kind", "matched_words", "coverage", "first_word", "last_word", "first_char", "last_char"]
        for b in slices(batches):
            rows = []
            for d, t in zip(b.column("doc_id").to_pylist(), text_bytes(b), strict=True):
                found = index.findings(t)
                if found:
                    page, byte, at = _Page(t, [], np.zeros(0, np.int64)), 0, 0
                    for name, template, kind, m, c, first, end in found:      # apart, ascending
                        x, y = page.span(first)[0], page.span(end - 1)[1]
                        at += len(t[byte:x].decode())
                        stop = at + len(t[x:y].decode())
                        rows.append((d, name, template, kind, m, c, first, end, at, stop))
                        byte, at = y, stop
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id bigint, license string, template string, kind string, matched_words int, coverage double, "
             "first_word bigint, last_word bigint, first_char bigint, last_char bigint")
