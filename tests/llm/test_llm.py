import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadloom.llm import boosting, common, exact_dedup, labels, license_scan, line_dedup, near_dedup, quality, segmentation, sharding, substring_dedup, toxicity, words
from threadloom.llm.common import Workspace, connected_components
from threadloom.llm.decontaminate import find_contamination, remove_contaminated

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
VOCAB = [a + b for a in "abcdefgh" for b in "uvwxyz"]


def corpus(seed=0, n=60, repeat=True):
    """Texts with copies, near copies, shared passages, self repeats, nulls, empties and odd spaces."""
    rng = np.random.default_rng(seed)
    some = lambda k: " ".join(rng.choice(VOCAB, k))
    shared, out = [some(30) for _ in range(3)], []
    for i in range(n):
        t = some(int(rng.integers(1, 90)))
        if i % 5 == 1:
            t += "\n" + shared[i % 3] + "\t " + some(10)
        if i % 7 == 2 and i > 10:
            w = out[int(rng.integers(0, i))] or "a b"
            w = w.split(" ")
            w[int(rng.integers(0, len(w)))] = "edit"
            t = " ".join(w)
        if i % 9 == 4:
            t = (some(5) + " ") * 9
        if i % 11 == 6:
            t = out[i - 3].upper() if out[i - 3] else out[i - 3]
        out.append(t)
    return [*out, None, "", " ", "x", "x y", "É " * 30, "e é È", shared[0], "X Y"] if repeat else out


def frame(spark, texts, parts=3):
    # clashing and extra columns do no harm
    return spark.createDataFrame([(i, t, "en", "s", i) for i, t in enumerate(texts)], "doc_id long, text string, shard string, mark string, n long").repartition(parts)


def rows(df, *cols):
    return {r[0]: tuple(r)[1:] for r in df.select("doc_id", *cols).collect()}


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute_substring(texts, w=20):
    seen, out = set(), {}
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    for d, x in enumerate(split):
        gone = set()
        for i in range(len(x) - w + 1):
            k = tuple(x[i : i + w])
            if k in seen:
                gone.update(range(i, i + w))
            seen.add(k)
        out[d] = (len(x), len(gone), " ".join(v for i, v in enumerate(x) if i not in gone))
    return out


@pytest.mark.parametrize("hot", [2000, 1])
def test_substring(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "SHARD_SEGMENTS", hot)
    texts = corpus()
    got = rows(substring_dedup.remove_repeats(frame(spark, texts)), "n_words", F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["length"]), "kept_text")
    assert got == brute_substring(texts)
    assert sum(v[1] for v in got.values()) > 100


def test_substring_long_period(spark):
    texts = ["a b c " * 200, "z " * 500, " ".join(VOCAB * 5), " ".join(VOCAB)]
    assert rows(substring_dedup.remove_repeats(frame(spark, texts)), "n_words", F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["length"]), "kept_text") == brute_substring(texts)


def test_automaton():
    a = substring_dedup.SuffixAutomaton()
    a.add(b"a b a b c".split())
    a.add(b"b c d".split())
    assert a.matching(b"a b c d a b a c".split()) == [1, 2, 3, 3, 1, 2, 3, 1]


def brute_contamination(texts, items, w=13):
    tok = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    out = {}
    for d, t in enumerate(texts):
        x, hit, ids = tok(t), set(), set()
        for name, item in items:
            y = tok(item)
            wins = {tuple(y[i : i + w]) for i in range(len(y) - w + 1)} if len(y) >= w else ({tuple(y)} if y else set())
            for k in wins:
                for i in range(len(x) - len(k) + 1):
                    if tuple(x[i : i + len(k)]) == k:
                        hit.update(range(i, i + len(k)))
                        ids.add(str(name))
        out[d] = (len(x), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(x))
    return out


@pytest.mark.parametrize("block", [50_000, 7])
def test_contamination(spark, block):
    texts = corpus(3)
    items = [(1, texts[3]), (20, texts[6]), (3, "au-AU bv"), (4, None), (5, "..."), (6, " ".join((texts[11] or "").split()[2:22])), (7, texts[6])]
    b = spark.createDataFrame(items, "item_id long, text string")
    got = find_contamination(frame(spark, texts), b, block_windows=block)
    assert rows(got, "n_words", "n_hit", "item_ids", "contaminated") == brute_contamination(texts, items)
    for r in got.where("size(matches) > 0").collect():
        x = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r.text.translate(LOW))
        for m in r.matches:
            y = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", dict((str(k), v) for k, v in items)[m.item_id].translate(LOW))
            assert x[m.word : m.word + m.length] == y[m.item_word : m.item_word + m.length]
    kept = remove_contaminated(frame(spark, texts), b)
    assert kept.columns == frame(spark, texts).columns and kept.count() == sum(not v[3] for v in brute_contamination(texts, items).values())
    assert remove_contaminated(frame(spark, texts), b.limit(0)).count() == len(texts)


def test_contamination_compares_words(monkeypatch):
    """Words of one hash that differ are no match."""
    from threadloom.llm import decontaminate

    def weak(data, starts, ends):
        return np.array([len(data[a:b]) + 1 for a, b in zip(starts, ends, strict=True)], np.uint64)

    monkeypatch.setattr(words, "bytes_hash", weak)
    items = [("x", "ab cd ef gh ij"), ("y", "kl mn")]
    texts = ["zz ab cd ef gh ij", "ab cd ef gh xx kl mn", "aa bb cc dd ee", None, ""]
    tests = next(decontaminate.test_blocks(items, 3, 100))
    found = []
    for w in words.chunked_words(pa.array(texts), words.ALNUM):
        text, item, offset, word, length = decontaminate.longest(w, tests)
        found += [(int(t) + w.first, tests.ids[i], int(o), int(p), int(n)) for t, i, o, p, n in zip(text, item, offset, word, length, strict=True)]
    assert sorted(found) == [(0, "x", 0, 1, 5), (1, "x", 0, 0, 4), (1, "y", 0, 5, 2)]


def brute_near(texts, k, percent):
    sets = []
    for t in texts:
        x = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets.append({tuple(x[i : i + k]) for i in range(len(x) - k + 1)} if len(x) >= k else ({tuple(x)} if x else set()))
    at = list(range(len(texts)))
    find = lambda i: i if at[i] == i else find(at[i])
    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = find(i), find(j)
                at[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def near_corpus():
    """A base with more and more edits, so that links fail between some copies; many copies make frequent shingles."""
    rng = np.random.default_rng(5)
    base, out = list(rng.choice(VOCAB, 120)), corpus(7, 40)
    for i in range(70):
        w = list(base)
        for j in rng.choice(120, i % 9, replace=False):
            w[j] = f"e{i}x{j}"
        out.append(" ".join(w))
    big = list(rng.choice([f"w{k}" for k in range(5000)], 1500))
    return [*out, " ".join(big), " ".join([*big[:1490], "tail"]), " ".join(big[:700])]


@pytest.mark.parametrize(("k", "percent", "rare", "block"), [(3, 90, 32, 1024), (5, 80, 2, 1024), (3, 90, 2, 16), (3, 60, 4, 20)])
def test_near(spark, monkeypatch, k, percent, rare, block):
    monkeypatch.setattr(near_dedup, "RARE", rare)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(common, "FEW_EDGES", 0 if block == 16 else 200_000)
    texts = near_corpus()
    assert rows(near_dedup.near_duplicates(frame(spark, texts), k, percent), "n_shingles", "component_id") == brute_near(texts, k, percent)


@pytest.mark.parametrize(("m", "block"), [(300, 64)])
def test_pairs_grow_with_nodes(spark, monkeypatch, m, block):
    """A group of m near copies: what is compared comes to few pairs for each node, whatever the group's size."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "RARE", 16)
    rng, made, write = np.random.default_rng(8), {}, near_dedup.Workspace.write
    base = list(rng.choice(VOCAB, 150))
    texts = []
    for i in range(m):
        w = list(base)
        for j in rng.choice(150, 1 + i % 3, replace=False):
            w[j] = f"e{i}x{j}"
        texts.append(" ".join(w))

    def counted(self, df, name, columns=None):
        out = write(self, df, name, columns)
        made[name] = out.count() if re.fullmatch(r"near|wide|cross|more_\d+", name) else 0
        return out

    monkeypatch.setattr(near_dedup.Workspace, "write", counted)
    got = rows(near_dedup.near_duplicates(frame(spark, texts), 3, 90), "n_shingles", "component_id")
    assert got == brute_near(texts, 3, 90)
    assert sum(made.values()) <= 4 * m, made


def test_exact_comparison_of_words():
    """Texts are compared word by word: hashes that collide link nothing."""
    x, y = "a b c d e f g h i j".split(), "a b c d e f g h i k".split()
    b = lambda w: [t.encode() for t in w]
    rng = np.random.default_rng(0)
    for _ in range(60):
        x, y = list(rng.choice(list("abcd"), int(rng.integers(0, 30)))), list(rng.choice(list("abcd"), int(rng.integers(0, 30))))
        for k in (1, 3, 5):
            s, t = near_dedup._shingles(b(x), k), near_dedup._shingles(b(y), k)
            if x and y:
                assert near_dedup._overlap_of_long(b(x), b(y), k) == (len(s & t), len(s), len(t))
    odd = "a"
    while len(odd) < 2048:
        odd += odd.translate(str.maketrans("ab", "ba"))
    texts = pa.array([f"x y {odd} z u", f"x y {odd.translate(str.maketrans('ab', 'ba'))} z u"])
    s, t = near_dedup.shingle_sets(texts, 3)
    assert not set(s.tolist()) & set(t.tolist())


def test_near_drop(spark):
    texts = near_corpus()
    kept = near_dedup.drop_near_duplicates(frame(spark, texts))
    want = brute_near(texts, 5, 80)
    assert kept.columns == frame(spark, texts).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, (n, c) in want.items() if i == c or not n}


def test_forest_spans():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 40, (2, 200))
    keep = near_dedup._forest(a, b, rng.random(200))

    def parts(edges):
        group = {int(n): {int(n)} for n in {*a, *b}}
        for x, y in edges:
            both = group[x] | group[y]
            for n in both:
                group[n] = both
        return len({min(g) for g in group.values()})

    every, some = list(zip(a.tolist(), b.tolist(), strict=True)), [(int(a[i]), int(b[i])) for i in keep]
    assert parts(every) == parts(some) and len(some) == len({*a, *b}) - parts(every)


@pytest.mark.parametrize("few", [0, 200_000])
def test_components(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW_EDGES", few)
    e = [(i, i + 1) for i in range(60) if i not in (20, 40)] + [(100, 7), (200, 300)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(e, "a long, b long"), Workspace(spark, "t"), "cc").collect()}
    assert got[20] == 0 and got[100] == 0 and got[40] == 21 and got[60] == 41 and got[300] == 200


def test_exact(spark):
    texts = [*corpus(2), "Ä", "ä", None, ""]
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[(t or "").translate(LOW)].append(i)
    want = {i: (max(g), len(g), i == max(g), sha(t)) for t, g in groups.items() for i in g}
    assert rows(exact_dedup.exact_duplicates(frame(spark, texts)), "keep_id", "group_size", "kept", "digest") == want
    # a digest of one digit: collisions are told apart by full bytes; the state lasts over several batches
    weak = exact_dedup.exact_duplicates(frame(spark, texts), digest=lambda t: F.substring(F.sha2(t, 256), 1, 1), files_per_trigger=1)
    assert rows(weak, "keep_id", "group_size", "kept") == {k: v[:3] for k, v in want.items()}
    kept = exact_dedup.drop_exact_duplicates(frame(spark, texts))
    assert kept.columns == frame(spark, texts).columns and {r.doc_id for r in kept.collect()} == {k for k, v in want.items() if v[2]}


def test_exact_repeated_rows_and_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (1, "A"), (1, "a"), (None, "a"), (None, "b"), (None, "b")], "doc_id long, text string")
    out = exact_dedup.exact_duplicates(df).collect()
    assert sorted((r.digest == sha("a"), r.group_size, r.kept) for r in out) == [(False, 2, False), (False, 2, True), (True, 4, False), (True, 4, False), (True, 4, False), (True, 4, True)]
    assert exact_dedup.drop_exact_duplicates(df).count() == 2


def test_lines(spark):
    rng = np.random.default_rng(4)
    texts = ["\n".join(rng.choice(["a", "b", "", "long line"], int(rng.integers(1, 14)))) for _ in range(40)] + [None, "", "\n", "\n\n", "x\ny\nz", "x\ny\nz\nx\ny\nz"]
    seen, want = set(), {}
    for d, t in enumerate(texts):
        x, gone = [] if t is None else t.split("\n"), set()
        for i in range(len(x) - 2):
            k = tuple(x[i : i + 3])
            if k in seen:
                gone.update((i, i + 1, i + 2))
            seen.add(k)
        want[d] = (len(x), sorted(gone), "\n".join(v for i, v in enumerate(x) if i not in gone))
    assert rows(line_dedup.dedup_lines(frame(spark, texts)), "n_lines", "removed", "kept_text") == want


def test_shards(spark, tmp_path):
    texts = corpus(1) * 3 + ["y" * 5000]
    df = frame(spark, texts)
    out = sharding.shard_documents(df, 2000).collect()
    assert len(out) == len(texts)
    by = defaultdict(list)
    for r in out:
        by[r.shard].append(r)
    for name, g in by.items():
        assert len(name) == g[0].depth and g[0].shard_bytes == sum(r.n_bytes for r in g) and g[0].shard_docs == len(g) and (g[0].shard_bytes <= 2000 or len(g) == 1)
        assert all(f"{int(sha(str(r.doc_id))[:15], 16):060b}".startswith(name) for r in g)
        assert not any(o != name and o.startswith(name) for o in by)
        if name:  # it was split because its parent is too large
            assert sum(r.n_bytes for o, h in by.items() if o.startswith(name[:-1]) for r in h) > 2000
    same = spark.createDataFrame([(1, "z" * 100)] * 50, "doc_id long, text string")
    got = sharding.shard_documents(same, 1000).collect()
    assert len(got) == 50 and all(r.shard_bytes <= 1000 and r.depth > 60 for r in got)
    sharding.write_shards(df, str(tmp_path / "s"), 2000)
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(texts)


def test_segmentation_round_trip(spark):
    texts = [*corpus(6, 20), "▁ raw ▁▁", "tabs\t\tand  \n\n spaces  ", "😀 emoji \x00 nul", "日本語のテキスト", "a" * 5000, "word " * 2000]
    s = segmentation.Sampler()
    out = segmentation.decode_pieces(segmentation.encode_pieces(frame(spark, texts), s), s)
    got = rows(out, "decoded", "piece_ids")
    assert {k: v[0] for k, v in got.items()} == dict(enumerate(texts))
    again = rows(segmentation.encode_pieces(frame(spark, texts, 1), s), "piece_ids")
    assert {k: v[1] for k, v in got.items()} == {k: v[0] for k, v in again.items()}
    assert again != rows(segmentation.encode_pieces(frame(spark, texts), segmentation.Sampler(seed=1)), "piece_ids")


def test_blocks_do_not_change_samples(spark, monkeypatch):
    texts = [*corpus(6, 20), "a\n\n  b   \n c ", None, " ", "word \n" * 300, "x" * 700]
    s, key = segmentation.Sampler(), np.arange(len(texts))
    want = s.encode([t or "" for t in texts], key)
    for size in (1, 50, 999):
        monkeypatch.setattr(segmentation, "BLOCK_CHARS", size)
        got = s.encode([t or "" for t in texts], key)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
    # a document of 5 MB, of words and newlines, and one of nulls only
    monkeypatch.undo()
    long = "lorem ipsum  dolor\n" * 250_000
    out = segmentation.decode_pieces(segmentation.encode_pieces(spark.createDataFrame([(1, long), (None, None)], "doc_id long, text string"))).collect()
    assert {r.doc_id: r.decoded for r in out} == {1: long, None: None}


def test_sampling_follows_the_lattice():
    s, w = segmentation.Sampler(), "tokens"
    pieces = segmentation.Pieces.load(s.path)
    ids = {t.decode(): i for i, t in enumerate(pieces.text) if t and np.isfinite(pieces.weight[i])}

    def ways(u):
        if not u:
            yield (), 0.0
        for k in range(1, len(u) + 1):
            if u[:k] in ids:
                for rest, x in ways(u[k:]):
                    yield (ids[u[:k]], *rest), x + pieces.weight[ids[u[:k]]]

    every = dict(ways(" " + w))
    total = sum(map(np.exp, every.values()))
    flat, n = s.encode([w] * 40_000, np.arange(40_000))
    count, at = defaultdict(int), 0
    for m in n:
        count[tuple(flat[at : at + m].tolist())] += 1
        at += m
    assert set(count) <= set(every) and max(abs(count[k] / 40_000 - np.exp(v) / total) for k, v in every.items()) < 0.01


LABELLED = 400


def labelled(spark, col):
    rng = np.random.default_rng(2)
    texts, y = [], []
    for i in range(LABELLED):
        w = list(rng.choice(VOCAB, 60))
        bad = i % 3 == 0
        if col == "toxic" and bad:
            w[5:5] = ["you", "are", "an", "IDIOT!"] if i % 2 else ["you", "st*pid", "m0ron"]
        if col == "quality" and not bad:
            w = [x + "###" for x in w]
        texts.append(" ".join(w))
        y.append(int(bad))
    docs = frame(spark, [*texts, None, ""])
    return docs, spark.createDataFrame([(i, v) for i, v in enumerate(y)] + [(None, 1), (7, None)], f"doc_id long, {col} int"), y


def test_toxicity(spark):
    docs, y_df, y = labelled(spark, "toxic")
    model = toxicity.fit_toxicity(docs, y_df)
    out = rows(toxicity.score_toxicity(docs, model), "toxicity", labels.held_out(F.col("doc_id")))
    held = [i for i in range(LABELLED) if out[i][1]]
    assert held and boosting.auc(np.array([out[i][0] for i in held]), np.array([y[i] for i in held])) > 0.97
    assert all(0 <= v[0] <= 1 for v in out.values()) and out[LABELLED][0] == out[LABELLED + 1][0]
    kept = toxicity.remove_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() < docs.count()
    none = toxicity.fit_toxicity(docs, y_df.limit(0))
    assert len({round(v[0], 9) for v in rows(toxicity.score_toxicity(docs, none), "toxicity").values()}) == 1


def test_features():
    x = toxicity.features(pa.array(["you IDIOT! you", "st*pid 1d10t", None, "fine text of%%%"]), toxicity.Lexicon.of())
    f = toxicity.FEATURES.index
    assert x[0, f("hits")] > 0 and x[0, f("near_you")] > 0 and x[1, f("hits")] == 0 and x[1, f("disguised")] > 0 and not x[2].any() and x[3, f("hits")] == 0


def brute_features(t, lex, you, learnt, near=5):
    """Features of one text in plain Python; learnt maps terms (whole words with a closing mark, or beginnings) to weights."""
    t = (t or "").encode()
    spans = [(m.start(), m.group().translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))) for m in re.finditer(rb"[A-Za-z\x80-\xff]+", t)]
    w = [x for _, x in spans]
    weight = [max([0.0, learnt.get(x + b"$", 0), *(learnt.get(x[:k], 0) for k in toxicity.PREFIXES if len(x) >= k)]) for x in w]
    marked, hit, at_you = [i for i, x in enumerate(weight) if x], [i for i, x in enumerate(w) if x in lex], [i for i, x in enumerate(w) if x in you]
    leet = lambda x: x.translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ013457@$", b"abcdefghijklmnopqrstuvwxyzoieastas"))
    starred = {x[:i] + b"*" + x[i + 1 :] for x in lex if len(x) > 3 and x.isascii() for i in range(1, len(x) - 1)}
    masked = sum(leet(x) in {*map(leet, lex), *map(leet, starred)} for x in re.findall(rb"[A-Za-z\x80-\xff013457@$*]+", t))
    disguised = max(masked - len(hit), 0)
    n, size, alpha = max(len(w), 1), max(len(t), 1), max(len(re.findall(rb"[A-Za-z]", t)), 1)
    sign = rb"[\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]"
    inner = len(re.findall(rb"(?<=[A-Za-z\x80-\xff])(?!['-])" + sign + rb"(?=[A-Za-z\x80-\xff])", t))
    log = np.log1p
    return [
        log(len(marked)), len(marked) / n, log(len({w[i] for i in marked})), max(weight, default=0), sum(weight) / max(len(marked), 1),
        log(len(hit)), len(hit) / n, log(len({w[i] for i in hit})), log(disguised), disguised / n, log(sum(any(abs(i - j) <= near for j in at_you) for i in {*hit, *marked})), len(at_you) / n,
        len(re.findall(rb"[A-Z]", t)) / alpha, len(re.findall(rb"(?<=[A-Z])[A-Z]", t)) / alpha, t.count(b"!") / size, t.count(b"?") / size, len(re.findall(sign, t)) / size, inner / n, len(re.findall(rb"[0-9]", t)) / size,
        log(len(w)), len(re.findall(rb"[A-Za-z\x80-\xff]", t)) / n,
    ]


def test_features_against_plain_python():
    rng = np.random.default_rng(3)
    bits = ["you", "IDIOT", "st*pid", "m0ron", "Crétin", "loweiä", "loweiung", "vequ", "fine-word", "it's", "a&b", "x!!", "why?", "12", "\n", "ça", "YOUR", "tr@sh", "***", "É"]
    texts = [" ".join(rng.choice(bits, int(rng.integers(0, 30)))) for _ in range(60)] + [None, "", " ", "!", "you" * 2000 + " idiot"]
    learnt = {b"lowei": 2.0, b"vequ$": 1.5, "crétin".encode()[:6]: 0.7}
    hashes = {}
    for term, weight in learnt.items():
        word = term.rstrip(b"$")
        found = dict(zip(("$", *toxicity.PREFIXES), toxicity.terms(words.words_of(np.frombuffer(word, np.uint8), np.array([0, len(word)]), toxicity._LETTERS, 0, 1)), strict=True))
        hashes[int(found["$" if term.endswith(b"$") else len(term)][1][0])] = weight
    order = sorted(hashes)
    x = toxicity.features(pa.array(texts), toxicity.Lexicon.of(), toxicity.Learnt(np.array(order, np.uint64), np.array([hashes[k] for k in order])))
    lex, you = {w.encode() for w in toxicity.LEXICON}, {w.encode() for w in toxicity.SECOND_PERSON}
    want = np.array([brute_features(t, lex, you, learnt) for t in texts])
    for j, name in enumerate(toxicity.FEATURES):
        assert np.allclose(x[:, j], want[:, j]), name


def test_learnt_terms(spark):
    rng, rows = np.random.default_rng(4), []
    for i in range(600):
        w = list(rng.choice(VOCAB, 40))
        if i % 5 == 0:
            w[3:3] = ["zork" + "abcdef"[i // 5 % 6] * 3]
        rows.append((" ".join(w), int(i % 5 == 0), i % 4 + 1))
    learnt, by_part = toxicity.learn_terms(spark.createDataFrame(rows, "text string, label int, part int"))
    x = toxicity.features(pa.array(["a zorkxyz", "au bv", None]), toxicity.Lexicon.of(), learnt)
    assert x[:, toxicity.FEATURES.index("learnt")].tolist() == [np.log1p(1), 0, 0] and set(by_part) == {1, 2, 3, 4}
    # a term that one part alone has isn't among those its own rows are judged by
    odd = [(f"{t} mostodd" if p == 2 and y else t, y, p) for t, y, p in rows]
    learnt, by_part = toxicity.learn_terms(spark.createDataFrame(odd, "text string, label int, part int"))
    odd_at = toxicity.FEATURES.index("learnt")
    seen = lambda m: toxicity.features(pa.array(["mostodd"]), toxicity.Lexicon.of(), m)[0, odd_at] > 0
    assert seen(learnt) and not seen(by_part[2]) and seen(by_part[1])
    none, _ = toxicity.learn_terms(spark.createDataFrame([r for r in rows if r[1]], "text string, label int, part int"))
    assert not len(none.hashes)


def test_quality_rules_compile(spark):
    docs, y_df, y = labelled(spark, "quality")
    model = quality.fit_quality(docs, y_df)
    out = rows(quality.score_quality(docs, model), "quality")
    assert model.rules and boosting.auc(np.array([out[i][0] for i in range(LABELLED)]), np.array(y)) > 0.97
    stats = docs.select("doc_id", *[c.cast("double").alias(k) for k, c in quality.statistics(F.col("text")).items()]).toPandas()
    x = stats[list(quality.STATISTICS)].to_numpy()
    raw = model.intercept + sum(r.weight * r.holds(x, quality.STATISTICS) for r in model.rules)
    assert all(abs(out[i][0] - s) < 1e-9 for i, s in zip(stats.doc_id, boosting.sigmoid(raw), strict=True))
    assert not quality.fit_quality(docs, y_df.limit(0)).rules


def test_isotonic_and_lasso():
    rng = np.random.default_rng(0)
    x = np.sort(rng.random(300))
    knots, v = boosting.fit_isotonic(x, (rng.random(300) < x).astype(float))
    assert (np.diff(v) >= 0).all() and (np.diff(knots) > 0).all()
    a = (rng.random((500, 6)) < 0.5).astype(float)
    b, w = boosting.fit_lasso(a, (a[:, 0] == 1).astype(float), 0.01)
    assert w[0] > 2 and np.abs(w[1:]).max() < 0.3


def test_licenses(spark):
    texts = ["prose of all kinds\nReleased under the MIT License.\nmore", "Licensed under the Apache Licence, Version 2.0", "the license plate of a car", None, "", "x " * 3000 + "Licensed under CC BY-NC 4.0. " + "y " * 3000, "MIT students"]
    got = rows(license_scan.scan_licenses(frame(spark, texts)), F.transform(F.filter("licenses", lambda x: x["confirmed"]), lambda x: F.struct(x["license"], x["differences"], x["line"])))
    flat = {k: [tuple(x) for x in v[0]] for k, v in got.items()}
    assert flat == {0: [("MIT", 0, 1)], 1: [], 2: [], 3: [], 4: [], 5: [("CC-BY-NC-4.0", 0, 0)], 6: []}
    loose = rows(license_scan.scan_licenses(frame(spark, texts), slack=0.2), F.transform(F.filter("licenses", lambda x: x["confirmed"]), lambda x: x["license"]))
    assert loose[1][0] == ["Apache-2.0"]


def test_licenses_against_brute_force():
    """Texts in which templates, some of the caller's own, stand with few or many words changed, across lines and in prose."""
    own = {"fox": "quick brown foxes jump over seven lazy dogs and two sleepy cats near the old river bank today", "short": "tiny grant", "BSD-3-Clause": license_scan.TEMPLATES["BSD-3-Clause"], "Apache-2.0": license_scan.TEMPLATES["Apache-2.0"]}
    scanner, rng = license_scan.Scanner(own), np.random.default_rng(7)

    def nearest(want, have):
        row = [0] * (len(have) + 1)
        for i, w in enumerate(want, 1):
            last, row = row, [i]
            for j, x in enumerate(have, 1):
                row.append(min(last[j - 1] + (w != x), last[j] + 1, row[j - 1] + 1))
        return min(row)

    seen = set()
    for _ in range(150):
        parts = []
        for name in rng.choice(list(own), int(rng.integers(0, 3)), replace=False):
            w = own[name].split()
            for i in rng.choice(len(w), int(rng.integers(0, min(4, len(w)))), replace=False):
                w[i] = "changed"
            parts += [" ".join(rng.choice(VOCAB, 25)), ("\n" if rng.random() < 0.5 else " ").join(w)]
        text = " ".join([*parts, *rng.choice(VOCAB, 20)])
        have = license_scan.words(text)
        want = {k for k, t in own.items() if nearest(license_scan.words(t), have) <= scanner.slack * len(license_scan.words(t))}
        found = scanner.scan(text)
        assert {r["license"] for r in found if r["confirmed"]} == want, text
        seen |= want
    assert seen == set(own)


def test_words_match_plain_splitting():
    texts = ["a  b\tc", "", None, "É é\x0bz", "  lead", "x" * 10]
    out = []
    for w in words.chunked_words(pa.array(texts), words.PLAIN, 4):
        out += np.diff(w.bounds).tolist()
    assert out == [len((t or "").encode().split()) for t in texts]
    # words made of Thue-Morse sequences, which polynomials modulo a power of two can't tell apart
    odd = "a"
    while len(odd) < 2048:
        odd += odd.translate(str.maketrans("ab", "ba"))
    for size in (1000, 2048):
        two = f"{odd[:size]} {odd[:size].translate(str.maketrans('ab', 'ba'))} {odd[:size]}".encode()
        h = words.words_of(np.frombuffer(two, np.uint8), np.array([0, len(two)]), words.PLAIN, 0, 1).hashes
        assert h[0] == h[2] != h[1]
    a = words.words_of(np.frombuffer(b"ab cd ab", np.uint8), np.array([0, 8]), words.PLAIN, 0, 1).hashes
    assert a[0] == a[2] != a[1]


@pytest.mark.parametrize("run", [
    lambda d: substring_dedup.remove_repeats(d), lambda d: near_dedup.near_duplicates(d), lambda d: exact_dedup.exact_duplicates(d), lambda d: line_dedup.dedup_lines(d), lambda d: sharding.shard_documents(d, 10),
    lambda d: segmentation.encode_pieces(d), lambda d: license_scan.scan_licenses(d), lambda d: exact_dedup.drop_exact_duplicates(d), lambda d: near_dedup.drop_near_duplicates(d),
])
def test_empty_tables(spark, run):
    assert run(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_null_ids_and_repeated_rows(spark):
    t = " ".join(VOCAB[:30])
    df = spark.createDataFrame([(None, t), (5, t), (5, t), (None, None)], "doc_id long, text string")
    gone = sorted((r.doc_id is None, sum(x.length for x in r.removed)) for r in substring_dedup.remove_repeats(df).collect())
    assert gone == [(False, 30), (False, 30), (True, 0), (True, 0)]
    near = near_dedup.near_duplicates(df, 3, 90).collect()
    assert sorted((r.n_shingles, r.component_id) for r in near if r.n_shingles) == [(28, 5)] * 3
    assert near_dedup.drop_near_duplicates(df).count() == 2
