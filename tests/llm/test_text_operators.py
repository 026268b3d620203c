"""Quality rules, license scan, language identification, tokens, packing, token files, pieces: against brute force, with edge rows."""

import random
import re
import weakref
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import langid, licenses, packing, pieces, quality, tokenfile, tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}" for i in range(30_000))
#: Rows with further columns whose names the operators use themselves.
CLASH = ("n", "ids", "nr", "h", "bundle", "kind", "start", "share", "path", "part")
EDGE = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n ", "en", None, 3), (4, "one", "en", "a", 3), (4, "one", "en", "a", 3), (None, "a null id here", "en", "b", 14), (5, LONG, "en", "a", len(LONG)), (6, "1234 5678 ##", "de", "c", 12), (7, "x " * 40, "fr", "c", 80), (8, "Ünï cödé 日本語  two  spaces \n\n end ", "de", "b", 30)]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS)


@pytest.fixture(scope="module")
def bpe():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary("byte_bpe_50k.json"))


def statistics(text):
    text = text or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    runs = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    twice = Counter(runs)
    covered = {j for i, r in enumerate(runs) if twice[r] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_statistics_equal_brute_force(spark, edge):
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abcd", k=rng.randint(0, 60))).replace("d", "\n") for _ in range(60)]
    more = spark.createDataFrame([(100 + i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    got = quality.judge(edge.unionByName(more).withColumn("n_words", F.lit(-1)).withColumn("kept", F.lit("x")), quality.DecisionList([])).collect()
    assert len(got) == len(EDGE) + 60
    for r in got:
        want = statistics(r["text"])
        assert tuple(r[c] for c in quality.STATISTICS) == want
        failed = want[0] < 20 or 100 * want[4] > 30 * want[0]
        assert r["base_failed"] == failed and r["kept"] == (not failed)


def test_rules_are_learned_and_emitted(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("aeioulnrst", k=rng.randint(2, 8)))
    good = [(i, " ".join(word() for _ in range(60))) for i in range(150)]
    bad = [(1000 + i, " ".join(word() + "###" for _ in range(60))) for i in range(60)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in good + bad] + [(1, None, 0), (None, 0, 0), (5000, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    rules = quality.fit(docs, labels)
    assert rules.rules
    kept = {r["doc_id"]: r["kept"] for r in quality.judge(docs, rules).collect()}
    assert sum(kept[i] for i, _ in good) >= 147 and sum(kept[i] for i, _ in bad) <= 2
    assert quality.fit(docs, labels.limit(0)).rules == []
    assert quality.judge(docs.limit(0), rules).count() == 0
    assert quality.judge(docs, rules).where("kept").count() == sum(kept.values())


def test_license_rules(spark, edge):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\nRedistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    binary = "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
    cases = [(1, "text\nLicensed under CC BY-NC 4.0.\nmore", "CC-BY-NC-4.0"), (2, "Released under the MIT License.", "MIT"), (3, bsd + binary, "BSD-2-Clause"), (4, bsd, None), (5, "No license here. Really", None), (6, "This work is licensed under the GNU General Public License, version 3. x", "GPL-3.0"), (7, None, None)]
    d = spark.createDataFrame([(i, t, "own") for i, t, _ in cases], "doc_id long, text string, license string")
    assert {r["doc_id"]: r["license"] for r in licenses.scan(d).collect()} == {i: x for i, _, x in cases}
    assert licenses.scan(edge).where("license is not null or licenses <> ''").count() == 0
    assert licenses.scan(d.limit(0)).count() == 0


def test_each_license_rule_fires_on_its_real_notice(spark):
    gpl = "This program is free software{a} you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation{b} either version {v} of the License, or\n(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful."
    mit = 'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the "Software"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n\n'
    kept = "The above copyright notice and this permission notice shall be included in all\ncopies or substantial portions of the Software.\n"
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice,\n   this list of conditions and the following disclaimer in the documentation\n   and/or other materials provided with the distribution.\n\n"
    cases = [
        ("BSD-3-Clause", bsd + "3. Neither the name of the copyright holder nor the names of its\n   contributors may be used to endorse or promote products derived from\n   this software without specific prior written permission.\n"),
        ("BSD-2-Clause", bsd),
        ("MIT", mit + kept),
        ("MIT", mit),
        ("MIT", "Released under the MIT License."),
        ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n'),
        ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
        ("GPL-3.0-or-later", gpl.format(a=":", b=",", v=3)),
        ("GPL-3.0-or-later", gpl.format(a=";", b=";", v=3)),
        ("GPL-2.0-or-later", gpl.format(a=";", b=";", v=2)),
        ("GPL-2.0-or-later", gpl.format(a=":", b=",", v=2)),
        ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
        ("GPL-3.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007"),
        ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
        ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
        ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/."),
        ("ISC", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n"),
        ("ISC", "Permission to use, copy, modify, and distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n"),
        ("Unlicense", "This is free and unencumbered software released into the public domain.\n"),
        ("MIT", "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + mit + kept + '\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\nFITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE\nAUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER\nLIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,\nOUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE\nSOFTWARE.\n'),
        ("Apache-2.0", "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.\n\n"),
        ("Apache-2.0", '      "License" shall mean the terms and conditions for use, reproduction,\n      and distribution as defined by Sections 1 through 9 of this document.\n'),
        ("AGPL-3.0-or-later", gpl.format(a=":", b=",", v=3).replace("General", "Affero General")),
        ("AGPL-3.0-or-later", gpl.format(a=";", b=";", v=3).replace("General", "Affero General")),
        ("LGPL-3.0-or-later", gpl.format(a=":", b=",", v=3).replace("General", "Lesser General")),
        ("LGPL-3.0-or-later", gpl.format(a=";", b=";", v=3).replace("General", "Lesser General")),
        ("LGPL-2.1-or-later", gpl.format(a=";", b=";", v="2.1").replace("General", "Lesser General").replace("program", "library")),
        ("EPL-2.0", "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/\n\nSPDX-License-Identifier: EPL-2.0\n"),
        ("EPL-2.0", "This program and the accompanying materials are made available under the\nterms of the Eclipse Public License v. 2.0 which is available at\nhttp://www.eclipse.org/legal/epl-2.0.\n"),
        ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright\nand related and neighboring rights to this software to the public domain\nworldwide. This software is distributed without any warranty.\n"),
        ("CC0-1.0", "You should have received a copy of the CC0 Public Domain Dedication along with\nthis software. If not, see <http://creativecommons.org/publicdomain/zero/1.0/>.\n"),
        ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
        ("Zlib", "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages\narising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not\n   claim that you wrote the original software.\n"),
        ("Zlib", "Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not\n"),
        ("BSL-1.0", 'Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission is hereby granted, free of charge, to any person or organization'),
        ("BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization\nobtaining a copy of the software and accompanying documentation covered by\nthis license (the "Software") to use, reproduce, display, distribute,\nexecute, and transmit the Software, and to prepare derivative works of the\nSoftware, and to permit third-parties to whom the Software is furnished to\ndo so, all subject to the following:\n'),
        ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0.\n   (See accompanying file LICENSE_1_0.txt or copy at\n         https://www.boost.org/LICENSE_1_0.txt)\n"),
    ]
    d = spark.createDataFrame(list(enumerate(t for _, t in cases)), "doc_id long, text string")
    assert {r["doc_id"]: r["license"] for r in licenses.scan(d).collect()} == {i: x for i, (x, _) in enumerate(cases)}
    assert {x for x, _ in cases} == {x for x, _ in licenses.RULES}


def test_language_identification(spark, edge):
    rng = random.Random(2)
    syllables = {"xx": ["tha", "ing", "ou", "er", "the"], "yy": ["sch", "ung", "ei", "ach", "der"]}
    text = lambda k: " ".join("".join(rng.choices(syllables[k], k=rng.randint(1, 3))) for _ in range(50))
    rows = [(i, text(k), k, "s", 0) for i, k in enumerate(["xx", "yy"] * 60)]
    docs = spark.createDataFrame(rows, DOCS)
    found = langid.fit(docs.where(~langid.held_out()))
    assert set(found) == {"xx", "yy"}
    got = langid.identify(docs.withColumn("score", F.lit("mine")), found).collect()
    assert all(r["lang_pred"] == r["lang"] and 0 < r["score"] <= 1 for r in got)
    odd = langid.identify(edge, found).collect()
    assert len(odd) == len(EDGE) and {r["lang_pred"] for r in odd if not r["text"] or not re.search(r"[^\W\d_]", r["text"])} == {"und"}
    assert langid.fit(docs.limit(0)) == {} and langid.fit(edge.withColumn("lang", F.lit(None).cast("string"))) == {}
    assert {r["lang_pred"] for r in langid.identify(docs, {}).collect()} == {"und"}
    assert langid.identify(docs.limit(0), found).count() == 0
    assert {r["lang_pred"] for r in langid.identify(docs.limit(4), {"xx": found["xx"]}).collect()} == {"xx"}


def test_languages_equal_plain_compression(spark):
    """Prediction and score of each row from zstandard alone, with ties, and a null id that is no fold's."""
    import zstandard

    rng = random.Random(6)
    syllables = {"xx": ["tha", "ing", "ou", "er"], "yy": ["sch", "ung", "ei", "ach"], "zz": ["sch", "ung", "ei", "ach"]}
    text = lambda k, n: " ".join("".join(rng.choices(syllables[k], k=rng.randint(1, 3))) for _ in range(n))
    rows = [(i, text(k, rng.randint(1, 80)), k) for i, k in enumerate(["xx", "yy", "xx"] * 40)] + [(None, "thaing erou", "xx"), (500, None, "xx"), (501, "...", "xx"), (502, "ÉCOLE " * 9000, "yy")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names = langid.fit(docs.where(~langid.held_out()))
    names["zz"] = names["yy"]  # ties with yy
    assert list(names) == ["xx", "yy", "zz"] and all(0 < len(x) <= langid.DICT_BYTES for x in names.values())
    own = {k: zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(v, dict_type=zstandard.DICT_TYPE_RAWCONTENT), level=langid.LEVEL, write_content_size=False) for k, v in names.items()}
    for r in langid.identify(docs, names).withColumn("held_out", langid.held_out()).collect():
        assert r["held_out"] is (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        if not r["text"] or not re.search(r"[^\W\d_]", r["text"]):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0.0, True)
            continue
        data = r["text"].lower().encode()
        size = {k: sum(len(c.compress(data[i : i + langid.BLOCK])) for i in range(0, len(data), langid.BLOCK)) for k, c in own.items()}
        best = min(size, key=lambda k: (size[k], k))
        second = min(size[k] for k in size if k != best)
        assert r["lang_pred"] == best and abs(r["score"] - (1 - size[best] / second)) < 1e-12 and r["rejected"] == (1 - size[best] / second < langid.MIN_MARGIN)


def test_passages_spread_over_whole_texts(spark):
    d = spark.createDataFrame([("".join(chr(97 + i) * 100 for i in range(26)),), ("short",), ("é" * 40,)], "text string")
    got = [r[0] for r in d.select(langid.passages(F.col("text"), F.lit(10))).collect()]
    parts = got[0].split("\n")
    assert [len(x) for x in parts] == [10] * 4 and parts[0] == "a" * 10 and parts[3] == "z" * 10 and got[1:] == ["short", "é" * 40]


def fuzz(alphabet, n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices(alphabet, k=rng.randint(0, 10))) for _ in range(n)]


def test_a_chunk_of_one_word_is_kept_once(bpe):
    e = tokens.BpeEncoder(tokens.vocabulary("byte_bpe_50k.json"))
    for t in ("head plain other", "x plain, (other) plain", "  plain\n\nother plain", "plain"):
        assert np.frombuffer(e(t), "<u4").tolist() == bpe.encode(t, add_special_tokens=False).ids, t
    assert {"plain", "other"} <= e.plain.keys() and not {" plain", " other", "head"} & e.words.keys()
    assert "," in e.words


def test_a_worker_keeps_the_things_of_one_operator():
    """A worker outlives an operator: what one has kept is gone once another begins."""
    path = tokens.vocabulary("byte_bpe_50k.json")
    kept = weakref.ref(tokens.encoder(path))
    assert tokens.encoder(path) is kept()  # from task to task of one operator it stays
    dictionaries = {"en": b"these are words", "de": b"das sind Worte"}
    compressors = langid.compressors_of(dictionaries)
    assert kept() is None and langid.compressors_of(dictionaries) is compressors
    assert tokens.encoder(path)("these")


def test_ids_equal_the_library(bpe):
    e = tokens.BpeEncoder(tokens.vocabulary("byte_bpe_50k.json"))
    for t in fuzz([" ", "  ", "\n", "\t", "a", "b", "é", "1", "'s", ".", "\xa0", " ", "\x1c", "\x85", " x", "<|endoftext|>", "日"], 3000, 1) + [LONG, "x" * 500]:
        assert np.frombuffer(e(t), "<u4").tolist() == bpe.encode(t, add_special_tokens=False).ids, t
    assert e(None) == b""
    assert np.frombuffer(e("a <|endoftext|> b"), "<u4").tolist().count(50256) == 1


def test_pieces_equal_the_library(spark, edge):
    import hashlib

    own = pieces.PieceEncoder(tokens.vocabulary("piece_bpe_32k.model"))
    look = pieces.Lookup(own)
    for t in fuzz([" ", "  ", "   ", "\n", "\t", "a", "the", "é", "1", "'s", "▁", "日", "\U0001f600", "ing", "<s>", "<0x0A>", "http"], 3000, 2) + [LONG]:
        assert np.frombuffer(pieces.encoded(t, own, look)[0], "<i4").tolist() == own.library.encode(t), t
    got = pieces.encode_texts(edge, tokens.vocabulary("piece_bpe_32k.model"), end_id=2).collect()
    want = Counter()
    for i, t, *_ in EDGE:
        ids = own.library.encode(t or "") + [2]
        want[i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(own.library.decode(ids).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want
    assert pieces.encode_texts(edge.limit(0), tokens.vocabulary("piece_bpe_32k.model")).count() == 0


def test_token_blocks_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 513, 3000):
        x = rng.integers(0, 50_257, n).astype("<u4")
        x[rng.random(n) < 0.02] = 2**32 - 1
        assert (tokenfile.unpacked_blocks(*tokenfile.packed_blocks(x), n) == x).all()
    same = np.full(1000, 7, "<u4")
    starts, data = tokenfile.packed_blocks(same)
    assert len(data) == 14 and (tokenfile.unpacked_blocks(starts, data, 1000) == same).all()


def test_token_files(spark, edge, bpe):
    for c in CLASH:
        edge = edge.withColumn(c, F.lit("mine"))
    files = tokenfile.write_ids(edge, tokens.vocabulary("byte_bpe_50k.json"), end_id=2, file_ids=50)
    got = sorted(tokenfile.read_ids(files, with_ids=True).collect(), key=lambda r: r["start"])
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda x: -1 if x is None else x) and len(ids) == len(EDGE)
    at, texts = 0, defaultdict(list)
    for i, t, *_ in EDGE:
        texts[i].append(bpe.encode(t or "", add_special_tokens=False).ids + [2])
    for r in got:
        assert r["start"] == at and list(r["ids"]) in texts[r["doc_id"]] and r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        at += r["n_tokens"]
    assert tokenfile.read_ids(tokenfile.write_ids(edge.limit(0), tokens.vocabulary("byte_bpe_50k.json"), 2)).count() == 0


def test_packing_keeps_every_id_once(spark, edge, bpe):
    got = packing.pack(edge, tokens.vocabulary("byte_bpe_50k.json"), 1, length=64, window_sequences=4, bundle_ids=20_000).collect()
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r["sequence_id"]].append(r)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= rows[0]["padded_to"] <= 64 and rows[0]["padded_to"] & (rows[0]["padded_to"] - 1) == 0
    once = Counter()
    for r in got:
        once[r["doc_id"], r["doc_tokens"]] += r["length"]
    want = Counter()
    for i, t, *_ in EDGE:
        n = len(bpe.encode(t or "", add_special_tokens=False).ids) + 1
        want[i, n] += n
    assert once == want
    ids = np.array(bpe.encode(LONG, add_special_tokens=False).ids + [1], "<u4")
    for r in (r for r in got if r["doc_id"] == 5):
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    assert packing.pack(edge.limit(0), tokens.vocabulary("byte_bpe_50k.json"), 1).count() == 0


def test_balance_beyond_a_window_is_carried(spark):
    """After a very long document of one source, the next bundles give the other source all it has first."""
    rows = [(1003, "some words " * 3000, "a")] + [(i, f"a few more words {i}", "ab"[i % 2]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = packing.pack(docs, tokens.vocabulary("byte_bpe_50k.json"), 1, {"a": 0.5, "b": 0.5}, length=16, window_sequences=1, bundle_ids=1000).collect()
    long = min(r["sequence_id"] >> 32 for r in got if r["doc_id"] == 1003)
    later = defaultdict(lambda: defaultdict(list))
    for r in got:
        if r["sequence_id"] >> 32 > long:
            later[r["sequence_id"] >> 32][r["source"]].append((r["sequence_id"], r["offset"]))
    both = [x for x in later.values() if len(x) == 2]
    assert both and all(max(x["b"]) < min(x["a"]) for x in both)


def plain_packing(rows, total, share, bundles, size):
    """Per bundle the (doc_id, position) of its ids in order: queues, credits and balances on plain lists. rows: (bundle, h, nr, doc_id, source, n)."""
    out, held = {}, Counter()
    for b in range(bundles):
        own = sorted(r for r in rows if r[0] == b)
        queues = defaultdict(list)
        for _, _, _, i, s, n in own:
            queues[s] += [(i, k) for k in range(n)]
        before = sum(held.values())
        account = {s: share[s] * before - held[s] for s in queues}
        names = sorted(queues, key=lambda s: (s is not None, s or ""))  # accounts come in order of their sources, null first
        for s in names:
            held[s] += len(queues[s])
        done = []
        while any(queues.values()):
            live = [s for s in names if queues[s]]
            need, whole = min(size, sum(len(queues[s]) for s in live)), sum(share[s] for s in live)
            for s in live:
                account[s] += size * share[s] / whole
            room = need
            for late in (False, True):
                for s in sorted(live, key=lambda s: -account[s]) if late else live:
                    n = min(len(queues[s]), room) if late else max(0, min(int(account[s]), len(queues[s]), room))
                    done += queues[s][:n]
                    del queues[s][:n]
                    account[s] -= n
                    room -= n
        out[b] = done
    return out


def test_packing_equals_plain_lists(spark, bpe, monkeypatch):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(["one", "two", "three", "größe", "日本"], k=rng.randint(0, 40))), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(300)]
    rows += [(7, "the same row again and again", "a")] * 100
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for c in CLASH:
        docs = docs.withColumn(c, F.lit("mine"))
    path, length, windows, bundle_ids = tokens.vocabulary("byte_bpe_50k.json"), 32, 3, 700
    once = packing.encoded(docs, path, 1)
    monkeypatch.setattr(packing, "encoded", lambda *_: once)
    monkeypatch.setattr(packing, "SUMMED", 3)  # running sums over several runs
    got = packing.pack(docs, path, 1, length=length, window_sequences=windows, bundle_ids=bundle_ids).collect()
    ids = once.select(F.xxhash64("nr").alias("h"), "nr", "doc_id", "source", "n").collect()
    assert sorted((r["doc_id"], r["n"]) for r in ids) == sorted((i, len(bpe.encode(t, add_special_tokens=False).ids) + 1) for i, t, _ in rows)
    total = sum(r["n"] for r in ids)
    bundles = -(-total // bundle_ids)
    share = {s: sum(r["n"] for r in ids if r["source"] == s) / total for s in {r["source"] for r in ids}}
    want = plain_packing([(r["h"] % bundles, r["h"], r["nr"], r["doc_id"], r["source"], r["n"]) for r in ids], total, share, bundles, length * windows)
    mine = defaultdict(list)
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        b = mine[r["sequence_id"] >> 32]
        assert len(b) == (r["sequence_id"] & 0xFFFFFFFF) * length + r["offset"]
        b += [(r["doc_id"], r["start"] + k) for k in range(r["length"])]
    assert {b: x for b, x in want.items() if x} == dict(mine)


def test_windows_hold_target_shares():
    queues = {s: packing.Queue(share, 0.0) for s, share in (("a", 0.5), ("b", 0.3), ("c", 0.2))}
    for s, n in (("a", 5000), ("b", 3000), ("c", 2000)):
        for i in range(n // 100):
            queues[s].add(i, b"\0\0\0\0" * 100)
    windows = list(packing.windows(queues, 1000))
    assert len(windows) == 10
    for w in windows:
        held = Counter()
        for _, _, _, k, s in w:
            held[s] += k
        assert abs(held["a"] - 500) <= 2 and abs(held["b"] - 300) <= 2 and abs(held["c"] - 200) <= 2
    dry = {"a": packing.Queue(0.9, 0.0), "b": packing.Queue(0.1, 0.0)}
    dry["a"].add(1, b"\0\0\0\0" * 10)
    dry["b"].add(2, b"\0\0\0\0" * 500)
    assert [sum(p[3] for p in w) for w in packing.windows(dry, 100)] == [100, 100, 100, 100, 100, 10]
