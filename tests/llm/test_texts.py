"""Operators that look at each text by itself."""

import hashlib
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from depthforge.llm import decontam, licenses, lines, packing, pii, quality
from depthforge.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, source string, host string, n_words int"


def frame(spark, texts, source="s"):
    """Rows with further columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, source, "h", 1) for i, t in enumerate(texts)], SCHEMA)


EDGES = [None, "", " \n\t", "one", "a b c " * 20_000, "é😀 ß", "x\n\nx\nx", "x\n\nx\nx"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    df = QUERIES[name](spark, SF)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    r = con.execute(ORACLES[name])
    cols = [c[0] for c in r.description]
    assert sorted(tuple(x) for x in df.select(*cols).collect()) == sorted(r.fetchall())


# ---------------------------------------------------------------- personal data


def luhn(d):
    return sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(int(c) for c in reversed(d))) % 10 == 0


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for order, (kind, form) in enumerate(BASE.items()):
        for m in re.finditer(form, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}
            if ok[kind]:
                out.append((m.start(), order, kind, m.end()))
    return sorted(out)


def test_pii_spans(spark):
    texts = [*EDGES, "a@b.c_d@e.f", "a@b.c.d..x@y.z é", "+1 (017) 555-7713.", "1.2.3.4.5.6.7.8", "999.1.1.1 0255.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "x@y.z" * 300, "1." * 5000, "@" * 3000, "9" * 5000, "😀 a@b.co +49 30 1234567"]
    got = pii.find_pii(frame(spark, texts)).collect()
    assert len(got) == len(texts)
    for r in got:
        assert [(s.start, s.ord, s.kind, s.end) for s in r.pii_spans if s.kind in BASE] == base_spans(r.text)
        assert all(s.match == r.text[s.start : s.end] for s in r.pii_spans)


def test_pii_checksums_and_context(spark):
    rows = pii.find_pii(frame(spark, ["account GB82WEST12345698765432", "GB83WEST12345698765432", "token = " + "a1" * 20, "f" * 40])).orderBy("doc_id").collect()
    assert [[(s.kind, round(s.score, 2)) for s in r.pii_spans] for r in rows] == [[("iban", 1.0)], [], [("key", 0.6)], []]
    assert [r.text for r in pii.redact(frame(spark, ["x a@b.co y", None, ""])).orderBy("doc_id").collect()] == ["x <email> y", None, ""]


def test_pii_context_is_whole_words(spark):
    texts = ["ship 10.0.0.1", "the monkey " + "a1" * 20, "ip: 10.0.0.1", "my key=" + "a1" * 20, "1.2.3.4 visa 5.6.7.8 card 4111 1111 1111 1111", "server " + "x" * 40 + " 1.2.3.4"]
    got = [[(s.kind, round(s.score, 2)) for s in r.pii_spans] for r in pii.find_pii(frame(spark, texts)).orderBy("doc_id").collect()]
    assert got == [[("ip", 0.6)], [], [("ip", 0.9)], [("key", 0.6)], [("ip", 0.6), ("ip", 0.6), ("card", 1.0)], [("ip", 0.6)]]


def test_pii_many_matches(spark):
    texts = [" ".join(f"{i} u{i}@b.co 10.0.{i % 256}.1" for i in range(3000)), None]
    row, none = pii.find_pii(frame(spark, texts)).orderBy("doc_id").collect()
    assert [(s.start, s.ord, s.kind, s.end) for s in row.pii_spans if s.kind in BASE] == base_spans(texts[0]) and len(row.pii_spans) >= 6000 and none.pii_spans == []
    cut = pii.redact(frame(spark, texts)).orderBy("doc_id").first().text
    assert cut == " ".join(f"{i} <email> <ip>" for i in range(3000))


def test_pii_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["op2_pii"](spark, SF).collect():
        spans = base_spans(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, k, b in spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[2] == k for s in spans) for k in BASE]


# ---------------------------------------------------------------- quality and lines


def test_rules_on_edges(spark):
    for r in quality.rules(frame(spark, [*EDGES, "a b c a b c d # $$"])).collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        hit = {i + j for i, t in enumerate(tri) if len(w) < 1000 and tri.count(t) > 1 for j in range(3)}
        own = [x for x in (r.text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_dup_lines) == (len(w), sum(map(len, w)), len(own) - len(set(own)))
        assert r.n_repeat_words == (len(hit) if len(w) < 1000 else len(w)) and r.n_symbols == len(re.findall(r"[#*$%&|<>]", r.text or ""))


def test_frequent_lines_deplete(spark):
    good, own = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("w", 60), ("v", 500)))
    rows = [(i, f"Share this page now {'again and ' * 60}\n{'ok' if i else own}", "a", "h", 0) for i in range(5)] + [(9, good, "b", "h", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in quality.judge(df.withColumn("text", F.regexp_replace("text", "again and (again and )+", good)), limit=3).collect()}
    assert [got[i].kept for i in (0, 1, 9)] == [True, False, True] and got[1].n_boilerplate_words == 65 and got[9].n_boilerplate_words == 0
    assert quality.judge(df.limit(0)).count() == 0


def test_frequent_lines_are_cut(spark):
    rows = [(i, f"own {i % 2} text\nShare  page {i}\n\nend {chr(97 + i)}", "a" if i < 4 else "b", "h", 0) for i in range(7)] + [(9, None, "a", "h", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r.text for r in quality.cut_frequent(df, limit=3).collect()}
    assert got == {i: None if t is None else f"\nend {chr(97 + i)}" if i < 4 else t for i, t, *_ in rows}
    for r in quality.judge(df, limit=3).collect():
        assert r.n_words - r.n_boilerplate_words == len((got[r.doc_id] or "").split())


def test_line_dedup(spark):
    rows = [(i, f"own {chr(97 + i)}\nFooter 12\n\nFooter  7", "a", "h", 0) for i in range(10)] + [(99, None, "a", "h", 0), (98, "", None, None, None), (97, "Footer 1", "b", "h", 0)]
    rows[3] = (3, "Footer 1", "a", "h", 0)
    got = {r.doc_id: r for r in lines.drop_lines(spark.createDataFrame(rows, SCHEMA).withColumn("line", F.lit("x")), least=5).collect()}
    assert got[0].text == "own a\n" and (got[0].n_lines, got[0].n_dropped) == (4, 2) and got[3].text == "" and got[97].text == "Footer 1"
    assert got[99].text is None and got[98].text == "" and got[0].line == "x"


def test_line_dedup_small_hosts(spark):
    import corpus_pipeline

    rows = [(10 * h + i, f"own {chr(97 + 7 * h + i)}\nAll about us", f"host {h}", "h", 1) for h, n in enumerate((1, 2, 3, 9)) for i in range(n)]
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_boilerplate(spark, spark.createDataFrame(rows, SCHEMA), SF).collect()}
    assert got == {i: t if i < 20 else t.split("\n")[0] for i, t, *_ in rows}


def test_repeated_and_null_keys_in_lines(spark):
    good = " ".join(f"w{i}" for i in range(60))
    own = lambda k: f"{good} {chr(97 + k)}"
    rows = [(k, f"{own(k)}\nAll about us {k}", "a", "h", 0) for k in (1, 1, 2, 3)] + [(1, f"{good} x\nAll about us\nAll about us", "a", "h", 0), (None, "All about us 7", "a", "h", 0), (9, good + "\nAll  about us 5", "b", "h", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    few = quality.judge(df, limit=3)  # 3 documents have the line, however many rows
    assert few.agg(F.sum("n_boilerplate_words")).first()[0] == 0 and few.count() == len(rows)
    got = sorted((str(r.doc_id), r.n_words, r.n_boilerplate_words, r.kept) for r in quality.judge(df, limit=1).collect())
    assert got == sorted([*[(str(k), 65, 4, True) for k in (1, 1, 2, 3)], ("1", 67, 0, True), ("None", 4, 4, False), ("9", 64, 0, True)])
    cut = sorted((str(r.doc_id), r.text, r.n_dropped) for r in lines.drop_lines(df, ratio=0.9, least=3).collect())
    assert cut == sorted([*[(str(k), own(k), 1) for k in (1, 1, 2, 3)], ("1", f"{good} x\nAll about us\nAll about us", 0), ("None", "", 1), ("9", good + "\nAll  about us 5", 0)])
    assert lines.drop_lines(df, ratio=0.9, least=4).agg(F.sum("n_dropped")).first()[0] == 0


def test_many_frequent_lines(spark, monkeypatch):
    monkeypatch.setattr(lines, "BROADCAST_LINES", 0)  # salted
    rows = [(i, "\n".join([*(f"shared {chr(97 + j % 26)}{chr(97 + j // 26 % 26)}{chr(97 + j // 676)}" for j in range(3000)), f"own {chr(97 + i)}"]), "a", "h", 0) for i in range(12)]
    got = {r.doc_id: (r.text, r.n_dropped) for r in lines.drop_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: (f"own {chr(97 + i)}", 3000) for i in range(12)}


def test_licenses(spark):
    texts = [None, "", "Licensed under the Apache License, Version 2.0.", "All Rights Reserved!\nThis work is licensed under the GNU General Public License, version 3.", "not licensed under the mit license text"]
    texts.append("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files. x. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. The software is provided \"as is\", without warranty of any kind.")
    got = [r.licenses for r in licenses.scan_licenses(frame(spark, texts)).orderBy("doc_id").collect()]
    assert got == [[], [], ["Apache-2.0"], ["GPL-3.0", "Proprietary"], [], ["MIT"]] and licenses.scan_licenses(frame(spark, texts).limit(0)).count() == 0


APACHE = """   Copyright 2020 Jane Doe

   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License.
"""
MIT = """MIT License

Copyright (c) 2020 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
BSD = """Copyright 2020 Jane Doe

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors
   may be used to endorse or promote products derived from this software
   without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND
ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
"""
GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.

    You should have received a copy of the GNU General Public License
    along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""


def test_license_headers(spark):
    gpl2 = GPL.replace("software:", "software;").replace("version 3", "version 2")
    texts = [APACHE, MIT, BSD, GPL, gpl2, GPL.replace("This program is free", "Foo is free"), BSD.replace("the copyright holder nor", "Foo Inc. nor")]
    texts += [t.replace("\n", "\r\n") for t in (APACHE, MIT, BSD, GPL)] + ["".join(f" * {x}\n" for x in t.splitlines()) for t in (APACHE, MIT, BSD, GPL)]
    texts += ["prose without an end\nReleased under the MIT License\nmore", "." * 100_000 + "x", GPL.replace("either version 3 of the License, or\n    (at your option) any later version", "in any version")]
    got = [",".join(r.licenses) for r in licenses.scan_licenses(frame(spark, texts)).orderBy("doc_id").collect()]
    four = ["Apache-2.0", "MIT", "BSD-3-Clause", "GPL-3.0"]
    assert got == [*four, "GPL-2.0", "GPL-3.0", "BSD-3-Clause", *four, *four, "MIT", "", "GPL-unknown"]


def test_license_rules_are_ordered(spark):
    bsd2 = BSD[: BSD.index("3. Neither")] + BSD[BSD.index("THIS SOFTWARE") :]
    lgpl, agpl = (GPL.replace("GNU General", f"GNU {x} General") for x in ("Lesser", "Affero"))
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/."
    texts = [bsd2, lgpl, agpl, mpl, lgpl.replace("version 3", "version 2.1"), BSD + GPL, "".join(f"# {x}\n" for x in mpl.splitlines()), APACHE + "\nReleased under the MIT License.\n"]
    got = [r.licenses for r in licenses.scan_licenses(frame(spark, texts)).orderBy("doc_id").collect()]
    assert got == [["BSD-2-Clause"], ["LGPL-3.0"], ["AGPL-3.0"], ["MPL-2.0"], ["LGPL-2.1"], ["BSD-3-Clause", "GPL-3.0"], ["MPL-2.0"], ["Apache-2.0", "MIT"]]
    swapped = (("BSD-2-Clause", ("bsd-grant", "bsd-binary")), ("BSD-3-Clause", ("bsd-grant", "bsd-binary", "bsd-name")))
    assert [licenses.scan_licenses(frame(spark, [BSD]), rules=r).first().license for r in (swapped, swapped[::-1])] == ["BSD-2-Clause", "BSD-3-Clause"]


# ---------------------------------------------------------------- benchmark


def brute(text, items, window=13):
    w = [m.decode() for m in decontam.normal_words(text)]
    mask, found = set(), set()
    for item, t in items:
        x = [m.decode() for m in decontam.normal_words(t)]
        n = min(window, len(x))
        for i in range(len(x) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == x[i : i + n]:
                    mask |= set(range(j, j + n))
                    found.add(item)
    return len(w), len(mask), sorted(found)


ITEMS = [("1", "Tiny"), ("10", " ".join(f"w{i}" for i in range(20))), ("2", "two words"), ("3", None), ("4", "..."), ("5", " ".join(f"w{i}" for i in range(13)))]
DOCS = [None, "", "nothing here", "a TINY two-words b", " ".join(f"W{i}" for i in range(14)) + " end", "x " * 500 + "two words", "w1 " * 30, "Ünï tiny"]


@pytest.mark.parametrize("block", [decontam.BLOCK_WORDS, 1])
def test_decontamination(spark, block):
    bench = spark.createDataFrame([(i, t, 5) for i, t in [*ITEMS, (None, "zzz")]], "item_id string, text string, doc_id int")
    docs = frame(spark, DOCS)
    found = {r.doc_id: r for r in decontam.decide(decontam.find_contamination(docs, bench, block_words=block)).collect()}
    for i, t in enumerate(DOCS):
        n, hit, items = brute(t, ITEMS)
        assert (found[i].n_words, found[i].n_hit, found[i].items) == (n, hit, items)
        assert found[i].items_sha256 == hashlib.sha256(",".join(items).encode()).hexdigest() and found[i].contaminated == (hit > 0 and 20 * hit >= n)
    assert decontam.decontaminate(docs, bench, block_words=block).columns == docs.columns
    assert [r.doc_id for r in decontam.decontaminate(docs, bench, block_words=block).orderBy("doc_id").collect()] == [i for i in range(len(DOCS)) if not found[i].contaminated]
    cut = {r.doc_id: r.text for r in decontam.decontaminate(docs, bench, "span", block_words=block).collect()}
    assert cut[3] == "a  b" and cut[4] == " end" and cut[7] == "Ünï " and cut[5] == "x " * 500 and cut[0] is None and cut[6] == DOCS[6]
    assert decontam.find_contamination(docs, bench.limit(0)).where("size(items) > 0").count() == 0
    assert decontam.decontaminate(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("block", [decontam.BLOCK_WORDS, 3])
def test_decontamination_of_repeated_keys(spark, block):
    bench = spark.createDataFrame([(1, "alpha beta"), (2, "gamma delta"), (3, " ".join(f"v{i}" for i in range(90)))], "item_id int, text string")
    rows = [(1, "alpha beta one two", "s", "h", 1), (1, "gamma delta", "s", "h", 1), (None, "alpha beta", "s", "h", 1), (4, " ".join(f"v{i}" for i in range(20, 60)), "s", "h", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.items) for r in decontam.decide(decontam.find_contamination(df, bench, block_words=block)).collect())
    assert got == [("1", 2, 2, ["2"]), ("1", 4, 2, ["1"]), ("4", 40, 40, ["3"]), ("None", 2, 2, ["1"])]
    assert sorted(r.text for r in decontam.decontaminate(df, bench, "span", block_words=block).collect()) == ["", "", "", " one two"]


# ---------------------------------------------------------------- packing


def test_solver():
    import random

    rng = random.Random(4)
    for n in (1, 2, 7, 40, 400):
        counts = {}
        for _ in range(n):
            x = rng.randrange(1, 101)
            counts[x] = counts.get(x, 0) + 1
        for plan in (packing.best_fit(counts, 100), packing.bin_completion(counts, 100)):
            got = {}
            for pattern, times in plan:
                assert sum(pattern) <= 100 and times > 0
                for x in pattern:
                    got[x] = got.get(x, 0) + times
            assert got == counts
        assert sum(t for _, t in packing.bin_completion(counts, 100)) <= sum(t for _, t in packing.best_fit(counts, 100))
    assert packing.bin_completion({}, 100) == []
    with pytest.raises(ValueError):
        packing.bin_completion({101: 1}, 100)


def least(pieces, size):
    """The fewest sequences, by trying every place of every piece."""
    best = len(pieces)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(pieces):
            best = len(bins)
            return
        for k in {b: j for j, b in enumerate(bins)}.values():
            if bins[k] + pieces[i] <= size:
                place(i + 1, [*bins[:k], bins[k] + pieces[i], *bins[k + 1 :]])
        place(i + 1, [*bins, pieces[i]])

    place(0, [])
    return best


def test_solver_is_optimal_on_small_inputs():
    import random
    from collections import Counter

    rng = random.Random(11)
    for _ in range(60):
        pieces = sorted((rng.randrange(5, 70) for _ in range(rng.randrange(1, 10))), reverse=True)
        counts = Counter(pieces)
        used = sum(t for _, t in packing.bin_completion(counts, 100, 10_000, 100_000, 50))
        assert packing.lower_bound(counts, 100) <= used == least(pieces, 100)


def test_bin_completion_beats_best_fit():
    counts = {60: 1, 44: 1, 36: 1, 24: 1, 20: 1, 16: 1}  # 60+24+16, 44+36+20
    assert sum(t for _, t in packing.bin_completion(counts, 100)) == 2
    assert packing.fillings({24: 1, 20: 1, 16: 1, 40: 1}, [16, 20, 24, 40], 40, 3, 100)[0] == (40,)


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    texts = [None, "", "a b c " * 900, "éß 日本語 😀 <|endoftext|>", "x <|endoftext|> y", *[f"text {i} " * (i % 50) for i in range(60)], "same", "same"]
    rows = packing.pack(frame(spark, texts), 64, with_ids=True).collect()
    tok = Tokenizer.from_file(packing.default_tokenizer()[0])
    by_doc, by_seq = {}, {}
    for r in rows:
        assert r.length == len(r.ids) and zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r.ids)) == r.ids_crc32
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    for i, t in enumerate(texts):
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [x for r in own for x in r.ids] == [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        assert [r.piece for r in own] == list(range(len(own))) and all(r.length == 64 for r in own[1:])
        assert [r.start for r in own] == [sum(q.length for q in own[:k]) for k in range(len(own))]
    for own in by_seq.values():
        end = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= 64
    assert packing.pack(frame(spark, texts).limit(0)).count() == 0
