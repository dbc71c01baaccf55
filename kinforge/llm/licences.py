"""License scans with a generalised suffix automaton of licence tokens.

All templates are put into one automaton over words; each of its states knows every
place in every template where its words end. A text's words are looked up among the
templates' words; runs of known words are streamed through the automaton, which gives
at each word the longest match that ends there. Matches of at least MIN_MATCH words
are chained per template while they advance in text and template with gaps of at most
GAP words, by dynamic programming; where two matches overlap, words count once. A chain
covers a span of its template. Its label is found if

* the chain covers COVER of the template's words, and
* it covers OWN of the template's own phrases (runs of MIN_MATCH words that no template
  of another label has), if there are any, and
* no longer chain of another label holds more than half of the same words of the text.

So a licence is told from others that quote it, and a common sentence has no label.
Labels of phrases that the caller names (the base) are found wherever a phrase stands,
within longer names too: a notice of the GNU Lesser General Public License holds
"general public license", so it has both labels.

Defined cases: a null or wordless text has no words, no labels and score 0; chains of
equal length are taken by the smaller label first; texts of any length are streamed
whole; repeated rows give repeated results; null ids pass through; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import NON_ALNUM, Words, blocks, one_hash, words

MIN_MATCH, GAP, COVER, OWN = 5, 40, 0.6, 0.5

# Phrases whose places are counted, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Whole texts of short public licences, and the notices by which longer ones are applied, by label.
TEMPLATES = {
    "mit": """permission is hereby granted free of charge to any person obtaining a copy of this software and associated
        documentation files the software to deal in the software without restriction including without limitation the rights to
        use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the
        software is furnished to do so subject to the following conditions the above copyright notice and this permission notice
        shall be included in all copies or substantial portions of the software the software is provided as is without warranty
        of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular
        purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other
        liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or
        the use or other dealings in the software""",
    "apache": """licensed under the apache license version 2 0 the license you may not use this file except in compliance with the
        license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law
        or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or
        conditions of any kind either express or implied see the license for the specific language governing permissions and
        limitations under the license""",
    "gpl": """this program is free software you can redistribute it and or modify it under the terms of the gnu general public
        license as published by the free software foundation either version 3 of the license or at your option any later version
        this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty
        of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have
        received a copy of the gnu general public license along with this program if not see http www gnu org licenses""",
    "lgpl": """this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general
        public license as published by the free software foundation either version 2 1 of the license or at your option any later
        version this library is distributed in the hope that it will be useful but without any warranty without even the implied
        warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details
        you should have received a copy of the gnu lesser general public license along with this library if not see http www gnu
        org licenses""",
    "agpl": """this program is free software you can redistribute it and or modify it under the terms of the gnu affero general
        public license as published by the free software foundation either version 3 of the license or at your option any later
        version this program is distributed in the hope that it will be useful but without any warranty without even the implied
        warranty of merchantability or fitness for a particular purpose see the gnu affero general public license for more details
        you should have received a copy of the gnu affero general public license along with this program if not see http www gnu
        org licenses""",
    "bsd-2-clause": """redistribution and use in source and binary forms with or without modification are permitted provided that the
        following conditions are met 1 redistributions of source code must retain the above copyright notice this list of
        conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this
        list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution
        this software is provided by the copyright holders and contributors as is and any express or implied warranties including
        but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no
        event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or
        consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits
        or business interruption however caused and on any theory of liability whether in contract strict liability or tort
        including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of
        such damage""",
    "bsd-3-clause": """redistribution and use in source and binary forms with or without modification are permitted provided that the
        following conditions are met 1 redistributions of source code must retain the above copyright notice this list of
        conditions and the following disclaimer 2 redistributions in binary form must reproduce the above copyright notice this
        list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution
        3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
        derived from this software without specific prior written permission this software is provided by the copyright holders
        and contributors as is and any express or implied warranties including but not limited to the implied warranties of
        merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors
        be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to
        procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any
        theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out
        of the use of this software even if advised of the possibility of such damage""",
    "isc": """permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
        provided that the above copyright notice and this permission notice appear in all copies the software is provided as is
        and the author disclaims all warranties with regard to this software including all implied warranties of merchantability
        and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages
        whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action
        arising out of or in connection with the use or performance of this software""",
    "zlib": """this software is provided as is without any express or implied warranty in no event will the authors be held liable for
        any damages arising from the use of this software permission is granted to anyone to use this software for any purpose
        including commercial applications and to alter it and redistribute it freely subject to the following restrictions 1 the
        origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this
        software in a product an acknowledgment in the product documentation would be appreciated but is not required 2 altered
        source versions must be plainly marked as such and must not be misrepresented as being the original software 3 this notice
        may not be removed or altered from any source distribution""",
    "mpl": """this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not
        distributed with this file you can obtain one at http mozilla org mpl 2 0""",
    "unlicense": """this is free and unencumbered software released into the public domain anyone is free to copy modify publish
        use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial
        or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software
        dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of
        the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of
        relinquishment in perpetuity of all present and future rights to this software under copyright law""",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
}


class Automaton:
    """Suffix automaton of several word sequences; ends[state]: each (sequence, place) where the state's words end."""

    def __init__(self, sequences: list[list[int]]):
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        for s in sequences:
            last = 0
            for c in s:
                last = self._extend(last, c)
        self.ends: list[list[tuple[int, int]]] = [[] for _ in self.step]
        for t, s in enumerate(sequences):
            state = 0
            for i, c in enumerate(s):
                state = self.step[state][c]
                up = state
                while up > 0:
                    self.ends[up].append((t, i))
                    up = self.link[up]

    def _split(self, p: int, c: int) -> int:
        q = self.step[p][c]
        if self.length[p] + 1 == self.length[q]:
            return q
        twin = len(self.step)
        self.step.append(dict(self.step[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = twin
            p = self.link[p]
        self.link[q] = twin
        return twin

    def _extend(self, last: int, c: int) -> int:
        if c in self.step[last]:
            return self._split(last, c)
        state, p = len(self.step), last
        self.step.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = state
            p = self.link[p]
        if p >= 0:
            to = self._split(p, c)
            self.link[state] = to
        return state

    def matches(self, run: list[int]) -> Iterator[tuple[int, int, int]]:
        """(end, length, state) of matches that the next word does not prolong."""
        state = length = 0
        for i, c in enumerate(run):
            if c not in self.step[state]:
                yield i, length, state
                while state > 0 and c not in self.step[state]:
                    state = self.link[state]
                    length = self.length[state]
                if c not in self.step[state]:
                    length = 0
                    continue
            state = self.step[state][c]
            length += 1
        yield len(run), length, state


class Scanner:
    def __init__(self, templates: dict[str, str], phrases: dict[str, str]):
        named = [(label, t.split()) for label, t in sorted(templates.items())]
        vocabulary = sorted({w for _, t in named for w in t})
        ids = {w: i for i, w in enumerate(vocabulary)}
        hashes = one_hash(vocabulary)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], order
        self.labels, self.sizes = [x for x, _ in named], [len(t) for _, t in named]
        self.automaton = Automaton([[ids[w] for w in t] for _, t in named])
        self.phrases = [(one_hash(p.split()), label) for p, label in phrases.items()]
        self.shortest = min(MIN_MATCH, *self.sizes) if named else 0
        runs: dict[tuple, set[str]] = defaultdict(set)
        for label, t in named:
            for i in range(len(t) - MIN_MATCH + 1):
                runs[tuple(t[i : i + MIN_MATCH])].add(label)
        self.own = [{i for i in range(len(t) - MIN_MATCH + 1) if len(runs[tuple(t[i : i + MIN_MATCH])]) == 1} for _, t in named]

    def known(self, w: Words) -> np.ndarray:
        """The vocabulary's number of each word, or -1."""
        if not len(self.hashes):
            return np.full(len(w.hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, w.hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == w.hashes, self.ids[at], -1)

    def base(self, w: Words) -> list[tuple[np.ndarray, str]]:
        """For each phrase the words where it starts."""
        out = []
        for p, label in self.phrases:
            here = np.flatnonzero(w.hashes == p[0])
            here = here[here + len(p) <= w.at[np.searchsorted(w.at, here, "right")]] if len(here) else here
            for k in range(1, len(p)):
                here = here[w.hashes[here + k] == p[k]]
            out.append((here, label))
        return out

    def spans(self, run: list[int], first: int) -> Iterator[tuple[int, int, int, int]]:
        """(template, first word, words, place in the template) of the long matches of a run."""
        for end, length, state in self.automaton.matches(run):
            if length >= self.shortest:
                for t, last in self.automaton.ends[state]:
                    if length >= min(MIN_MATCH, self.sizes[t]):
                        yield t, first + end - length, length, last - length + 1

    def chains(self, spans: list[tuple[int, int, int]], size: int) -> Iterator[tuple[int, list[tuple[int, int, int]]]]:
        """(words covered, spans) of chains of one template's spans (first word, words, place), best first; none shares a span with a better one."""
        spans = sorted(spans)
        best, back = [], []
        low = 0
        for k, (first, n, at) in enumerate(spans):
            while first - spans[low][0] > GAP + size:
                low += 1
            most, came = n, -1
            for i in range(low, k):
                f, m, a = spans[i]
                over = max(f + m - first, a + m - at, 0)  # words that both hold
                if f < first and a < at and over < n and first - f - m <= GAP and at - a - m <= GAP and best[i] + n - over > most:
                    most, came = best[i] + n - over, i
            best.append(most)
            back.append(came)
        used: set[int] = set()
        for k in sorted(range(len(spans)), key=lambda k: (-best[k], spans[k])):
            chain, i = [], k
            while i >= 0 and i not in used:
                chain.append(i)
                i = back[i]
            used.update(chain)
            if i < 0:
                yield best[k], [spans[x] for x in reversed(chain)]

    def found(self, spans: list[tuple[int, int, int, int]]) -> list[tuple[str, float, int, int]]:
        """(label, share of the template, first word, end) of the licences in a text."""
        by: dict[int, list] = defaultdict(list)
        for t, *span in spans:
            by[t].append(tuple(span))
        whole = []
        for t, own in by.items():
            if sum(n for _, n, _ in own) < COVER * self.sizes[t]:
                continue
            for covered, chain in self.chains(own, self.sizes[t]):
                if covered < COVER * self.sizes[t]:
                    break
                held = sum(any(at <= i and i + MIN_MATCH <= at + n for _, n, at in chain) for i in self.own[t])
                if held >= OWN * len(self.own[t]):
                    whole.append((-covered, self.labels[t], covered / self.sizes[t], chain[0][0], chain[-1][0] + chain[-1][1]))
        out: list[tuple[str, float, int, int]] = []
        for _, label, share, a, b in sorted(whole):
            if not any(x != label and 2 * (min(b, e) - max(a, s)) > b - a for x, _, s, e in out):
                out.append((label, share, a, b))
        return out

    def scan(self, column: pa.Array) -> dict[str, list]:
        w = words(column, lower=True, seps=NON_ALNUM)
        n = len(column)
        count, first, last = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        base: list[set[str]] = [set() for _ in range(n)]
        for places, label in self.base(w):
            rows = np.searchsorted(w.at, places, "right") - 1
            np.add.at(count, rows, 1)
            local = places - w.at[rows]
            for r, p in zip(rows.tolist(), local.tolist()):
                base[r].add(label)
                first[r] = p if first[r] < 0 else min(first[r], p)
                last[r] = max(last[r], p)
        spans: list[list] = [[] for _ in range(n)]
        ids = self.known(w)
        inside = np.concatenate([[False], ids >= 0, [False]])
        edge = np.zeros(len(ids) + 1, bool)
        edge[w.at] = True  # a run ends with its row
        start = np.flatnonzero(inside[1:] & (~inside[:-1] | edge))
        stop = np.flatnonzero(inside[:-1] & (~inside[1:] | edge))
        long_ = stop - start >= max(self.shortest, 1)
        for a, b in zip(start[long_].tolist(), stop[long_].tolist()):
            r = int(np.searchsorted(w.at, a, "right")) - 1
            spans[r].extend(self.spans(ids[a:b].tolist(), a - int(w.at[r])))
        labels, scores = [], []
        for r in range(n):
            found = self.found(spans[r]) if spans[r] else []
            labels.append(",".join(sorted(base[r] | {x[0] for x in found})))
            scores.append(1.0 if base[r] else max((x[1] for x in found), default=0.0))
        none = lambda x: [int(v) if v >= 0 else None for v in x]
        return {"n_words": w.counts.tolist(), "n_base": count.tolist(), "first_word": none(first), "last_word": none(last), "base_labels": [",".join(sorted(b)) for b in base], "labels": labels, "score": scores}


TYPES = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """One row for each document (doc_id, text): licence phrases, labels, and the best covered share of a template."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, phrases)
        for batch in batches:
            column, ids = batch.column("text"), batch.column("doc_id")
            for low, high in blocks(column):
                yield pa.RecordBatch.from_pydict({"doc_id": ids.slice(low, high - low)} | scanner.scan(column.slice(low, high - low)), TYPES)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)
