import random
import re
from collections import Counter

import pytest

from agorascope.llm import hattrie, phrases
from agorascope.llm.queries import ORACLES

SCHEMA = "doc_id long, text string, lang string, word string, `a.b` int, f long, path int, score long"


def brute(rows, least, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for size in range(1, 5):
                f.update((lang, *words[i : i + size]) for i in range(len(words) - size + 1))
    found = {}
    for (lang, *words), a in f.items():
        if len(words) < 2 or a < least:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = f[(lang, *words[:k])], f[(lang, *words[k:])]
            cuts.append((2_000_000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        found[lang, tuple(words)] = (a, left, right, score)
    gone = set()
    for (lang, words), (b, *_) in found.items():
        for size in range(2, len(words)):
            for i in range(len(words) - size + 1):
                part = lang, words[i : i + size]
                if 100 * b >= 80 * found[part][0]:
                    gone.add(part)
    out = []
    for lang in n:
        mine = sorted(
            (-score, -a, " ".join(words).encode(), left, right)
            for (of, words), (a, left, right, score) in found.items() if of == lang and (of, words) not in gone
        )
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(mine[:top])]
    return sorted(out)


def made(seed=1):
    r = random.Random(seed)
    vocabulary = ["the", "of", "New", "York", "é", "city", "x\x1cy", "日本", "a'b", "-"] + [f"w{i}" for i in range(60)]
    rows = []
    for _ in range(120):
        words = []
        for _ in range(r.randint(0, 60)):
            words.append(r.choice(vocabulary[:10] if r.random() < 0.6 else vocabulary))
            if r.random() < 0.1:
                words += r.choice([["new", "york", "city"], ["the", "old", "man", "and"], ["of", "the"]])
            if r.random() < 0.1:
                words[-1] += r.choice([",", ".", "\n", "\r\n", ";;", ":", "\v", "\f"])
        rows.append((r.choice([" ", "  ", "\t"]).join(words), r.choice(["en", "en", "de", None, "und"])))
    return rows + [(None, "en"), ("", "en"), (" \t,.\n", "xx"), ("the of " * 3000, "en"), ("a", "en"), ("a", "en")]


def frame(spark, rows):
    return spark.createDataFrame([(i % 7, t, l, "w", 1, 2, 3, 4) for i, (t, l) in enumerate(rows)], SCHEMA).repartition(3)


def listed(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("least, top, entries", [(3, 2000, 1 << 20), (2, 15, 64)])
def test_against_plain_counts(spark, least, top, entries):
    rows = made()
    got = listed(phrases.collocations(frame(spark, rows), least, top, entries))
    assert got == brute(rows, least, top) and len(got) > 30


def test_production_limits_and_sql(spark):
    rows = [(t, l) for t, l in made(2) for _ in range(6)]
    want = brute(rows, phrases.LEAST)
    assert listed(phrases.collocations(frame(spark, rows))) == want and len(want) > 20
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(con.execute(ORACLES["op12_phrase_counts"]).fetchall()) == want


def test_empty_table(spark):
    assert listed(phrases.collocations(frame(spark, []))) == []
    assert listed(phrases.collocations(frame(spark, [(None, None), ("", "en")]))) == []


def test_trie_bursts_and_spills(monkeypatch):
    """Counts stay right through bursts and spills; runs are sorted and subtrees whole."""
    monkeypatch.setattr(hattrie, "BURST", 16)
    r, want, got = random.Random(5), Counter(), Counter()
    trie = hattrie.HatTrie(limit=500)
    monkeypatch.setattr(hattrie.Node, "__init__", _small_node)
    trie.roots = [hattrie.Node() for _ in range(256)]
    ids = [r.getrandbits(64).to_bytes(8, "big") for _ in range(30)]
    bursts = spills = 0

    def take(runs):
        nonlocal spills
        for run in runs:
            assert run == sorted(run) and len({p[0] for p, _ in run}) == 1
            spills += 1
            for path, n in run:
                got[path] += n

    for _ in range(60):
        batch = Counter(b"".join([r.choice(ids[:3]), *r.choices(ids, k=r.randint(0, 3))]) for _ in range(80))
        want += batch
        paths = sorted(batch)
        trie.add(paths, [batch[p] for p in paths])
        assert trie.size == sum(len(list(n.items())) for n in trie.roots)
        bursts += sum(len(n.children) for n in trie.roots)
        take(trie.spill())
        assert trie.size <= 500
    take(trie.spill(all_=True))
    assert got == want and trie.size == 0 and bursts and spills > 10


def _small_node(self):
    self.containers, self.children = [{} for _ in range(hattrie.FAN)], {}
    self.bounds, self.size = [16] * hattrie.FAN, 0


def test_words_with_one_name_are_noticed(spark, monkeypatch):
    """Ids that clash make the count start again with other ids."""
    asked = []
    real = phrases._count_words

    def clashing(seed):
        asked.append(seed)
        inner = real(seed)
        if seed:
            return inner

        def run(batches):
            import pyarrow as pa

            for b in inner(batches):
                yield pa.record_batch([pa.array([b"same" * 2] * b.num_rows, pa.binary()), *b.columns[1:]], names=b.schema.names)

        return run

    monkeypatch.setattr(phrases, "_count_words", clashing)
    rows = made(4)
    assert listed(phrases.collocations(frame(spark, rows), 3)) == brute(rows, 3) and asked == [0, 1]
