import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from millrace.llm import fill_middle, ngram_join, oracles, queries, spelling
from tests.llm.test_documents import against_sql, brute_components

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def test_cuts_against_plain_units():
    rng = random.Random(1)
    texts = ["".join(rng.choice("a é\n中\t🙂 \x0b\x1c<") for _ in range(rng.randrange(40))) for _ in range(2000)] + ["x " * 300_000, "", "y"]
    first, second = (np.array([rng.getrandbits(32) for _ in texts]) for _ in range(2))
    for text, a, b, got in zip(texts, first.tolist(), second.tolist(), fill_middle.spans(texts, first, second).tolist()):
        units = UNIT.findall(text)
        low, high = sorted((a % (len(units) + 1), b % (len(units) + 1)))
        assert got == [len(units), len("".join(units[:low])), len("".join(units[low:high]))]


def test_ranks_of_the_matrix():
    symbols = np.random.default_rng(2).integers(0, 8, 1000).astype(np.uint8)
    matrix = fill_middle.WaveletMatrix(symbols, 3)
    places = np.array([0, 1, 63, 64, 65, 500, 999, 1000])
    for s in range(8):
        assert matrix.rank(s, places).tolist() == [int((symbols[:p] == s).sum()) for p in places]


def test_fill_middle_against_sql(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, "".join(rng.choice(["word", " ", "\n", "é", "<", "P>", "中 ", "🙂", "\t"]) for _ in range(rng.randrange(30)))) for i in range(300)]
    rows += [(1000 + i, t) for i in range(8) for t in (None, "", " \n ", "a<P>b c d", "one", "<<S two three")] + [(7, "again and again"), (7, "again and again"), (2000, "long " * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'f' as form", "1 as c", "2 as h0", "3 as n").repartition(3)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op12_fill_middle"](spark, str(tmp_path))
    against_sql(spark, oracles.FILL_MIDDLE, got, documents=df.select("doc_id", "text"))
    forms = Counter(r["form"] for r in got.filter("doc_id < 300").collect())
    assert got.filter("restored_sha256 = output_sha256").count() == got.filter("form = 'plain'").count()
    assert forms["plain"] > 100 and forms["spm"] > forms["psm"] > 5
    assert fill_middle.fill_middle(df.limit(0)).count() == 0
    null_id = spark.createDataFrame([(None, "a b c")], "doc_id long, text string")
    back = fill_middle.fill_middle(null_id, rate=100).withColumn("t", fill_middle.restore(fill_middle.F.col("output"), fill_middle.F.col("form")))
    assert back.first()["t"] == "a b c"


def grams(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i:i + 4]) for i in range(max(len(words) - 3, 1))} if words else set()


def brute_near(rows, percent=85):
    sets = [grams(t) for _, t in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    root = {i: i for i in range(len(rows))} | brute_components(pairs)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root[k]] = min(least.get(root[k], i), i)
    return sorted((str(i), len(sets[k]), least.get(root[k])) for k, (i, _) in enumerate(rows))


def copies(rng):
    words = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(25):
        text = [rng.choice(words) for _ in range(rng.choice([4, 6, 12, 40, 200]))]
        for _ in range(rng.randrange(1, 7)):
            rows.append((len(rows), " ".join(text)))
            for _ in range(rng.randrange(1 + len(text) // 60)):
                text[rng.randrange(len(text))] = "changed"
            if rng.random() < 0.3:
                text += ["more"] * rng.randrange(1, 3)
    return rows


@pytest.mark.parametrize("tree", [1 << 17, 500])
def test_ngram_join_against_brute_force(spark, monkeypatch, tree):
    monkeypatch.setattr(ngram_join, "GRAMS", tree)
    if tree == 500:
        monkeypatch.setattr(ngram_join, "BROADCAST_BYTES", 0)
    rng = random.Random(9)
    rows = copies(rng)
    base = [f"b{i}" for i in range(150)]
    for _ in range(40):  # a dense group that needs several small trees, and chains through it
        text = list(base)
        for _ in range(rng.randrange(4)):
            text[rng.randrange(150)] = f"x{rng.randrange(5)}"
        rows.append((len(rows), " ".join(text)))
    rows += [(500, None), (501, ""), (502, " \n"), (503, "One two"), (504, "one\ttwo"), (505, rows[0][1].upper()), (None, rows[0][1]), (None, "lonely row"),
             (3, rows[3][1]), (3, "another text under an id"), (506, "z " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "5 as s", "'z' as keys", "1 as id").repartition(4)
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in ngram_join.near_documents(df).collect())
    assert [x for x in got if x[0] != "None"] == [x for x in brute_near(rows) if x[0] != "None"]
    assert ("None", 1, None) in got and len(got) == len(rows)
    assert ngram_join.near_documents(df.limit(0)).count() == 0


def test_keys_lose_no_pair_and_trees_no_component():
    npr, rng = np.random.default_rng(3), random.Random(3)
    for _ in range(120):
        n = rng.choice([1, 2, 3, 4, 5, 7, 10, 20, 50, 200])
        base = npr.integers(0, 1 << 63, n * 3, dtype=np.uint64)
        sets = [np.unique(npr.choice(base[:n + n // 8], rng.randrange(max(1, int(n * .8)), n + 1), replace=False)) for _ in range(rng.randrange(2, 40))]
        sets = list({s.tobytes(): s for s in sets}.values())
        pairs = [(i, j) for i in range(len(sets)) for j in range(i)
                 if ngram_join.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]), 85)]
        keys = [set(ngram_join.part_keys(s, 85).tolist()) for s in sets]
        assert all(keys[i] & keys[j] for i, j in pairs)
        got, _ = ngram_join.tree_links(sets, list(range(len(sets))), list(range(len(sets))))
        assert {(max(p), min(p)) for p in got} <= set(pairs) and brute_components(got) == brute_components(pairs)


def test_near_copies_visit_few_nodes_each():
    npr = np.random.default_rng(4)
    base = npr.integers(0, 1 << 63, 300, dtype=np.uint64)
    for m in (100, 400):
        sets = [np.unique(np.concatenate([npr.choice(base, 290, replace=False), npr.integers(0, 1 << 63, 8, dtype=np.uint64)])) for _ in range(m)]
        got, visited = ngram_join.tree_links(sets, list(range(m)), list(range(m)))
        assert len(got) == m - 1 and visited < 4 * m


def test_sets_that_nearly_link_take_a_step_for_each_node():
    npr = np.random.default_rng(5)
    base = npr.integers(0, 1 << 63, 300, dtype=np.uint64)
    for m in (100, 400):
        sets = [np.unique(np.concatenate([npr.choice(base, 255, replace=False), npr.integers(0, 1 << 63, 45, dtype=np.uint64)])) for _ in range(m)]
        got, visited = ngram_join.tree_links(sets, list(range(m)), list(range(m)))
        assert got == [] and visited < 2 * m


def test_walkers_in_several_lots_find_the_same(monkeypatch):
    npr = np.random.default_rng(6)
    base = npr.integers(0, 1 << 63, 40, dtype=np.uint64)
    sets = [np.unique(npr.choice(base, npr.integers(30, 41), replace=False)) for _ in range(60)]
    links_of = lambda: brute_components(ngram_join.tree_links(sets, list(range(60)), list(range(60)))[0])
    whole = links_of()
    monkeypatch.setattr(ngram_join, "TABLE", 300)
    assert links_of() == whole


def plain_words(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[k + 1:] == b[k + 1:] if len(a) == len(b) else a[k:] == b[k + 1:]


def brute_variants(rows):
    n = plain_words(rows)
    form, out = {}, {}
    for w in n:
        near = [v for v in n if one_edit(w, v)]
        best = min(near, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
        out[w] = len(near)
    def root(w):
        while form[w]:
            w = form[w]
        return w
    return sorted((w, n[w], out[w], form[w], n.get(form[w]), root(w)) for w in n)


@pytest.mark.parametrize("blocks", [1 << 20, 70])
def test_spelling_variants_against_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(spelling, "MAX_BLOCKS", blocks)
    monkeypatch.setattr(spelling, "STORE", 50)
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdéÿ÷") for _ in range(rng.randrange(5, 9))) for _ in range(12)] + ["coloration", "aaaaaaa", "q" * 80]
    pool = []
    for word in base:
        pool += [word] * 60
        for _ in range(4):
            k = rng.randrange(len(word))
            pool += [word[:k] + rng.choice(["", "a", "x" + word[k]]) + word[k + 1:]] * rng.choice([2, 5, 11, 12])
    pool += ["Coloration", "aaaaaaaa", "aaaaaa"] * 5
    rng.shuffle(pool)
    rows = [(i, " ".join(pool[i::40]) + "\n中Ünder_word9") for i in range(40)] + [(100, None), (101, ""), (None, "letters " * 9), (7, "repeated repeated"), (7, "repeated repeated")]
    rows += [(200, "verylong" * 2000 + " " + "letters " * 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'w' as word", "2 as n", "3 as id").repartition(3)
    got = spelling.variants(df)
    have = sorted(tuple(r) for r in got.select("word", "n", "n_near", "form", "form_n", "root").collect())
    assert have == brute_variants(rows)
    assert any(w[3] for w in have) and got.count() == len(have)
    assert spelling.variants(df.limit(0)).count() == 0 and spelling.variants(df.filter("text is null")).count() == 0


def test_filters_pass_all_words_and_few_others():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(4000)]
    known, others = set(words[:2000]), [w for w in words[2000:]]
    sizes = spelling.shard_sizes({9: 2000})
    rows = {}
    for _, codes in spelling.by_length(sorted(known)):
        block, bits = spelling.places(spelling.linear(codes), 9, sizes[9])
        for b, x in zip(block.tolist(), bits.tolist()):
            for k in range(spelling.PROBES):
                bit = x >> 9 * k & 511
                rows.setdefault(b, [0] * 8)[bit >> 6] |= 1 << (bit & 63)
    signed = [(9, b, *[w - (1 << 64) if w >> 63 else w for w in ws]) for b, ws in rows.items()]
    filters = spelling.Filters(sizes, signed)
    passed = lambda ws: sum(len(filters.find(spelling.linear(codes), 9)) for _, codes in spelling.by_length(ws))
    assert passed(sorted(known)) == 2000 and passed(others) < 60
    assert len(filters.find(np.zeros(3, np.uint64), 12)) == 0
