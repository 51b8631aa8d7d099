"""Each operator against brute force, on rows with nulls, empty and long texts, ties, repeats and odd columns."""

import collections
import hashlib
import math
import random
import re
import types
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import bm25, licenses, neardup, packing, pieces, pii, quality, queries, superminhash, textbatch, toxicity, urlrules, warc

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\n", "one", "Two words", "a b c " * 300, "x" * 5000, "é ü 日本 \t z", "same text here", "same text here", "it's <|endoftext|> 12½"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, None if i % 2 else "en", i * 2, "clash") for i, t in enumerate(ODD)] + [(None, "same text here", None, 1, None), (3, "\n\n", "en", 6, "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words long, rep string")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def texts_of(df):
    return {r.doc_id: r.text or "" for r in df.collect()}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def test_signatures_equal_the_element_by_element_algorithm():
    random.seed(1)
    sets = [[random.getrandbits(64) for _ in range(n)] for n in (0, 1, 7, 300)]
    value, of = np.array([x for s in sets for x in s], np.uint64), np.repeat(np.arange(4), [len(s) for s in sets])
    got = superminhash.signatures(value, of, 4, 16)
    for row, s in zip(got, sets, strict=True):
        kept = [int(superminhash.EMPTY)] * 16
        for x in s:
            order = list(range(16))
            for level in range(16):
                draw = int(textbatch.mix(np.array([(x + (2 * level + 1) * int(textbatch.GAMMA)) % (1 << 64)], np.uint64))[0])
                pick = level + (((draw & 0xFFFFFFFF) * (16 - level)) >> 32)
                order[level], order[pick] = order[pick], order[level]
                kept[order[level]] = min(kept[order[level]], (draw >> 40) | level << 24)
        assert kept == row.tolist()


def groups_by_force(texts, k, share):
    def shingles(t):
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()

    own, up = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(own)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(own[a] & own[b])
            if both and 100 * both >= share * len(own[a] | own[b]):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(own[i]), find(i)) for i in ids}


def test_near_duplicates(spark, documents, odd):
    for df, k in ((documents, 2), (odd.where("doc_id is not null"), 5)):
        rows = neardup.groups(df, k).collect()
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == groups_by_force(texts_of(df), k, 80) and len(rows) == df.count()
    assert [r.kept for r in neardup.groups(odd).where("doc_id is null").collect()] == [True]
    assert neardup.groups(documents.limit(0)).count() == 0


def test_near_duplicates_of_one_large_group(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 8)
    random.seed(3)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(w if random.random() > 0.06 else f"v{random.randrange(40)}" for w in base)) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.groups(df, 2).collect()} == groups_by_force(dict(rows), 2, 80)


def test_few_links_need_no_rounds(spark, monkeypatch):
    """Chains over 40 partitions: one more union-find ends them; star rounds, for more links than one may hold, agree."""
    from graphloom.llm import components

    random.seed(5)
    links = [(i + 1, i) for i in range(300) if i % 50] + [(2000, 1000), (1500, 2000), (7, 7)]
    random.shuffle(links)
    want = {i: i // 50 * 50 + 1 for i in range(301) if i % 50 != 1 and i // 50 * 50 + 1 < i} | {i: i - 49 for i in range(50, 301, 50)} | {1500: 1000, 2000: 1000}
    df, kept, keep = spark.createDataFrame(links, "u long, v long").repartition(40), [], components.keep
    monkeypatch.setattr(components, "keep", lambda made, name: kept.append(name) or keep(made, name))
    assert {r.u: r.root for r in components.components(df).collect()} == want
    assert kept == ["forest", "roots"]
    monkeypatch.setattr(components, "HELD", 16)
    assert {r.u: r.root for r in components.components(df).collect()} == want and "stars" in kept


def test_near_duplicates_need_few_shuffles(spark, monkeypatch):
    """On a group of near copies that no single text links to all, the plans of the tables that are written have a bounded number of shuffles."""
    from graphloom.llm import components

    random.seed(4)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(w if random.random() > 0.05 else f"v{random.randrange(40)}" for w in base)) for i in range(60)]
    tables, keep = [], neardup.keep
    for module in (neardup, components):
        monkeypatch.setattr(module, "keep", lambda made, name: tables.append(made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")) or keep(made, name))
    made = neardup.groups(spark.createDataFrame(rows, "doc_id long, text string"), 2)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in made.collect()} == groups_by_force(dict(rows), 2, 80)
    assert sum(tables) <= 32, tables


def test_rows_of_one_doc_id_tie_their_classes(spark):
    one, two, near = "a b c d e f g", "q r s t u v w", "q  r s T u v w"
    rows = [(9, one), (9, two), (4, one), (6, near), (6, near), (6, two), (7, "else where this is"), (None, one)]
    made = neardup.groups(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in made) == [(0, 0), (4, 4), (6, 4), (6, 4), (6, 4), (7, 7), (9, 4), (9, 4)]


def test_sets_of_repeated_rows():
    """Of one doc_id, each set once, whatever the batches; of different ones, each its own."""
    rows = [(1, "a b c"), (1, "a  b C"), (1, "a b d"), (2, "a b d"), (2, "A b d"), (2, "a b c"), (2, "a b d")]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[0] for r in some], pa.int64()), pa.array([r[1] for r in some])], ["doc_id", "text"]) for some in (rows[:2], rows[2:5], rows[5:])]
    made = [(r["rep"], r["set"]) for b in neardup._sets(2, 9)(iter(batches)) for r in b.to_pylist()]
    assert [r[0] for r in made] == [1, 1, 2, 2] and made[0][1] == made[3][1] != made[1][1] == made[2][1]


def test_quality_measures(odd, documents):
    for df in (odd, documents):
        for r in quality.ledger(df).join(df.select("doc_id", "text"), "doc_id").collect():
            w, t = words(r.text or ""), r.text or ""
            three = collections.Counter(zip(w, w[1:], w[2:], strict=False))
            covered = {i + j for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for j in range(3)}
            lines = [x for x in t.split("\n") if words(x)]
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines), len(lines) - len(set(lines)), len(covered))
    ledger = quality.ledger(documents)
    n = {r.rule: r for r in quality.ablations(ledger).collect()}
    assert n["short"].n_failed == ledger.where("n_words < 50").count()
    assert quality.accepted(odd).columns == odd.columns


def test_packing(documents, odd):
    from tokenizers import Tokenizer

    path = queries.tokenizer("word_bpe_49k.json")
    reference = Tokenizer.from_file(path)
    for df in (documents, odd):
        rows = packing.pack(df, path, capacity=512).collect()
        made = collections.defaultdict(list)
        for r in rows:
            made[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
        for r in df.where("doc_id is not null").dropDuplicates(["doc_id"]).collect():
            ids = np.array([*reference.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
            want = [(i // 512, i, len(ids[i : i + 512]), zlib.crc32(ids[i : i + 512].tobytes())) for i in range(0, len(ids), 512)]
            assert sorted(set(made[r.doc_id])) == want
        bins = collections.defaultdict(list)
        for r in rows:
            bins[r.sequence_id].append((r.offset, r.length))
        for b in bins.values():
            end = 0
            for offset, length in sorted(b):
                assert offset == end
                end += length
            assert end <= 512
        best_fit: list[int] = []  # room left, by best fit decreasing
        for n in sorted((r.length for r in rows), reverse=True):
            room = min((x for x in best_fit if x >= n), default=None)
            if room is None:
                best_fit.append(512 - n)
            else:
                best_fit[best_fit.index(room)] = room - n
        assert len(bins) <= len(best_fit)


def summed(own, texts):
    return [row for _, _, t in textbatch.pieces(pa.array(texts, pa.large_string()), 4096) for row in own.summed(t)]


def test_pieces():
    import sentencepiece

    path = queries.tokenizer("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Encoder(path)
    more = ["  a  b ", "▁x▁", "a\n\nb \n c", " \n", "🎉 é\0", "<s> </s>"]
    asked = [t or "" for t in ODD] + more
    for t, got in zip(asked, summed(own, asked), strict=True):
        ids = library.encode(t)
        assert got[:3] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
        same, begin, end = own.spans(t)
        assert same == ids and (not ids or (begin[0] == 0 and end[-1] == len(t.encode()) and (begin[1:] == end[:-1]).all()))


def test_pieces_query_projects_every_text(spark, documents, odd):
    own = pieces.Encoder(queries.tokenizer("piece_bpe_32k.model"))

    def want(text):
        _, begin, end = own.spans(text)
        assert (begin[1:] == end[:-1]).all()
        return hashlib.sha256(np.append(begin, end[-1:]).astype("<u4").tobytes()).hexdigest()

    for df in (documents, odd):
        known = df.where("doc_id is not null").dropDuplicates(["doc_id", "text"])
        texts = collections.defaultdict(set)
        for r in known.collect():
            texts[r.doc_id].add(want(r.text or ""))
        got = collections.defaultdict(set)
        for r in pieces.digests(known, queries.tokenizer("piece_bpe_32k.model")).collect():
            got[r.doc_id].add(r.spans_sha256)
        assert got == texts
    strange = ["", " ", "a", "  a  b ", "▁x▁", "a ▁ b", "é \n日本 ", "🎉 é\0", "\n\n a\n", "a  ", " \n \U0010ffff x"]
    assert [x[3] for x in summed(own, strange)] == [want(t) for t in strange]
    # the same by the way of texts that can't be taken apart
    quick = summed(own, strange + [t or "" for t in ODD])
    own.fast = False
    assert summed(own, strange + [t or "" for t in ODD]) == quick


def test_character_map():
    # a trie of one entry: "a" -> "bc"
    units = [0] * 256
    units[0] = 1 << 10
    units[1 ^ ord("a")] = (ord("a") | 1 << 8) | 2 << 10
    units[1 ^ ord("a") ^ 2] = 0x80000000
    blob = len(units).__mul__(4).to_bytes(4, "little") + np.array(units, "<u4").tobytes() + b"bc\0"
    assert pieces.CharMap(blob).longest(b"xa", 1) == (b"bc", 1) and pieces.CharMap(blob).longest(b"x", 0) is None


def plain_pii(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 12 <= len(d := re.sub(r"\D", "", m.group())) <= 19 and pii.luhn(d)]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub(r"\D", "", m.group())) <= 15]
    return sorted(out)


@pytest.mark.parametrize("trim", [False, True])
def test_pieces_of_a_model_with_a_character_map(tmp_path, trim):
    """Ids and byte spans equal the library's where a map replaces characters and white space is trimmed."""
    import sentencepiece

    def number(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + number(n >> 7)

    # "q" -> "st", "qu" -> "", "é" -> "e": a double array of 256 units
    units = [0] * 512
    text, entries = b"", {}
    for k, v in (("q", "st"), ("é", "e")):
        entries[k.encode()] = len(text)
        text += v.encode() + b"\0"
    base = 256
    units[0] = base << 10
    q = base ^ ord("q")
    units[q] = ord("q") | 1 << 8 | (q ^ 300) << 10
    units[300] = 0x80000000 | entries[b"q"]
    lead, tail = "é".encode()
    x = base ^ lead
    units[x] = lead | (x ^ (400 ^ tail)) << 10
    units[400] = tail | 1 << 8 | (400 ^ 410) << 10
    units[410] = 0x80000000 | entries["é".encode()]
    blob = (4 * len(units)).to_bytes(4, "little") + np.array(units, "<u4").tobytes() + text
    spec = b"\x0a\x01x" + b"\x12" + number(len(blob)) + blob + b"\x18\x01" + b"\x20" + bytes([trim]) + b"\x28\x01"
    model = b"".join(bytes([tag << 3 | 2]) + number(len(v)) + v for tag, v in [(t, spec if t == 3 else v) for t, v in pieces.fields(open(queries.tokenizer("piece_bpe_32k.model"), "rb").read())])
    path = tmp_path / "mapped.model"
    path.write_bytes(model)
    library, own = sentencepiece.SentencePieceProcessor(model_file=str(path)), pieces.Encoder(str(path))
    assert own.map.units and not own.fast
    for t in ("a quiet café", "  éq  two   spaces ", "quququ é", "", "   ", "日本 q", "plain words only", "tab\tand\nline é q"):
        assert own.normalise(t)[0] == library.normalize(t)
        proto = library.encode(t, return_type="proto")
        ids, begin, end = own.spans(t)
        assert ids == [p.id for p in proto.pieces] and [(a, b) for a, b in zip(begin.tolist(), end.tolist(), strict=True)] == [(p.begin, p.end) for p in proto.pieces], t
        ((n, ids_sum, decoded, _),) = summed(own, [t])
        assert n == len(ids) and decoded == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_pii_base_equals_the_patterns():
    random.seed(5)
    for _ in range(3000):
        t = "".join(random.choice(["1", "25", ".", "4111111111111111", "@", "a", "b.c", "-", " ", "+", "(", ")", "999", "é", "\n"]) for _ in range(random.randint(1, 25)))
        assert pii.base(t) == plain_pii(t)


def test_pii_spans_and_redaction(spark):
    rows = [(i, f"mail a{i}@b.example now password=b7db7aa4a5fcc7830{i} AKIAMD62HKU6VBLCCCC{i} done word{i}") for i in range(9)] + [(20, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kinds = {r.doc_id: [x.kind for x in r.found] for r in pii.spans(df).collect()}
    assert kinds[0] == ["email", "secret", "secret"] and kinds[20] == []
    masked = {r.doc_id: r.text for r in pii.redacted(df).collect()}
    assert masked[1] == "mail [EMAIL] now password=[SECRET] [SECRET] done word1" and masked[20] is None


def test_toxicity_learns_and_shares_ngrams():
    random.seed(2)
    vocabulary = ["".join(random.choice("abcdefgh") for _ in range(random.randint(2, 7))) for _ in range(300)]
    texts, labels = [], []
    for i in range(400):
        t = [random.choice(vocabulary) for _ in range(60)]
        if i % 4 == 0:
            t[random.randrange(60)] = "zyxworthless"
        texts.append(" ".join(t))
        labels.append(int(i % 4 == 0))
    model = toxicity.train(texts, labels)
    asked = ["abc zyxworthles def", "abc def", "", "x" * 3000]
    score = np.concatenate([toxicity.score(t, model) for _, _, t in textbatch.pieces(pa.array(asked))])
    assert score[0] > 0.5 > score[1] and 0 <= score.min() and score.max() <= 1


def test_toxicity_learning_in_a_task_equals_training_here(spark, odd):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    model = toxicity.learn(docs, labels)
    usable = {r.doc_id: r.toxic for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    rows = docs.orderBy(F.xxhash64("doc_id")).collect()
    rows = [(r.text or "", usable[r.doc_id]) for r in rows if r.doc_id in usable]
    toxic = sum(y for _, y in rows)
    # the sample takes all labels here, so the weight of a clean one is 1
    assert 0 < toxic <= 1500 and len(rows) - toxic <= 3000
    want = toxicity.train([t for t, _ in rows], [y for _, y in rows])
    assert np.allclose(model[0], want[0], atol=1e-3) and np.allclose(model[1:], want[1:], atol=1e-3)
    # no labels, one class only, and a label without a document give the model of no knowledge
    for frame in (labels.limit(0), labels.withColumn("toxic", F.lit(0)), labels.select((F.col("doc_id") + 10**9).alias("doc_id"), "toxic")):
        assert not toxicity.learn(docs, frame)[0].any()
    # repeated ids, null ids and null texts are learned from without harm, and every row is scored
    some = spark.createDataFrame([(i, int(i in (3, 6)), 1) for i in range(len(ODD))] + [(None, 1, 1)], "doc_id long, toxic int, text int")
    scored = toxicity.scored(odd, toxicity.learn(odd, some)).collect()
    assert len(scored) == odd.count() and all(0 <= r["score"] <= 1 for r in scored)


def test_url_rules(spark):
    assert urlrules.fixed("www.example.com", "/en/7x") == ("example.com/en/7", "allow") and urlrules.fixed("a.com", "/en/") == ("com/en/", "block")
    assert urlrules.fixed("acom", "/en/") == (None, None) and urlrules.split("no scheme") == ("", "", "") and urlrules.split("x://A.B?q")[:2] == ("a.b", "")
    pages = spark.createDataFrame([(i, f"http://{'spam-site' if i % 2 else 'good'}.example.com/p/{i}") for i in range(60)] + [(99, None), (None, "")], "page_id long, url string")
    labels = spark.createDataFrame([(i, 0 if i % 2 else 1) for i in range(60)], "page_id long, quality int")
    verdicts = {r.page_id: r.verdict for r in urlrules.judge(pages, urlrules.mine(pages, labels)).collect()}
    assert verdicts[1] == "block" and verdicts[2] == "allow" and verdicts[99] == "allow"


def best_by_force(texts, asked, k):
    """texts: (doc_id, text) rows. (query, rank, doc_id, score) of all queries."""
    split = [(i, collections.Counter(re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(t or ""))) for i, t in texts if i is not None]
    df, n, mean = collections.Counter(w for _, c in split for w in c), len(split), sum(sum(c.values()) for _, c in split) / len(split)
    own = collections.defaultdict(set)
    for i, t in asked:
        if i is not None:
            own[i] |= {re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in words(t or "")}
    out = []
    for q, kinds in own.items():
        hits = []
        for i, c in split:
            norm = 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)
            s = math.fsum(math.log1p((n - df[w] + 0.5) / (df[w] + 0.5)) * (c[w] * 2.2 / (c[w] + norm)) for w in kinds if w in c)
            if s:
                hits.append((-round(s, 9), i))
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(hits)[:k], 1)]
    return sorted(out)


def assert_best(got, want):
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=1e-9)


def found(docs, asked, k):
    return sorted((r.query_id, r.rank, r.doc_id, r.score) for r in bm25.search(docs, asked, k).collect())


def test_bm25_equals_brute_force(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    for k in (5, 10):
        assert_best(found(documents, documents.where("doc_id % 50 = 0"), k), best_by_force(rows, [r for r in rows if r[0] % 50 == 0], k))


def test_bm25_on_odd_rows(spark, odd, documents):
    """Null, empty and long texts, repeated rows, ties, shared ids, clashing columns, empty tables."""
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert_best(found(odd, odd, 3), best_by_force(rows, rows, 3))
    ties = [(i, "same few words" if i % 3 else "same other words") for i in range(60, 0, -1)] + [(7, "same few words"), (7, "another text")]
    df = spark.createDataFrame(ties, "doc_id long, text string").repartition(5)
    assert_best(found(df, df, 10), best_by_force(ties, ties, 10))
    empty = documents.limit(0)
    assert found(empty, documents, 3) == found(documents, empty, 3) == found(odd.where("text = ' '"), odd, 3) == []


def test_bm25_in_many_segments(spark, monkeypatch):
    """Thresholds carried between segments and pivots lose nothing, whatever the segments' size."""
    random.seed(11)
    often, seldom = [f"o{i}" for i in range(12)], [f"s{i}" for i in range(400)]
    rows = [(i, " ".join(random.choices(often, k=random.randint(0, 30)) + random.choices(seldom, k=random.randint(0, 6)))) for i in range(700)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(24)
    asked = [r for r in rows if r[0] % 9 == 0]
    want = best_by_force(rows, asked, 4)
    part = spark.createDataFrame(asked, "doc_id long, text string")
    key = 3
    monkeypatch.setattr(bm25, "SEGMENT", 40)
    batch = lambda some: pa.RecordBatch.from_arrays([pa.array([r[0] for r in some]), pa.array([r[1] for r in some], pa.large_string())], ["doc_id", "text"])
    made = list(bm25._segments(key)(iter([batch(rows[a : a + 20]) for a in range(0, 700, 20)])))
    assert len(made) == 18 and sum(m.column("n")[0].as_py() for m in made) == 700
    assert_best(found(df, part, 4), want)


def test_bm25_segments_searched_together(monkeypatch):
    """Segments as one group: completed by matrix products or each by itself, with any threshold, all hits and exact scores."""
    random.seed(12)
    often, seldom = [f"o{i}" for i in range(12)], [f"s{i}" for i in range(400)]
    rows = [(i, " ".join(random.choices(often, k=random.randint(0, 30)) + random.choices(seldom, k=random.randint(0, 6)))) for i in range(700)]
    rows += [(700 + i, rows[i][1]) for i in range(30)]
    want = collections.defaultdict(list)
    for q, _, d, score in best_by_force(rows, rows[::9], 4):
        want[q].append((d, score))
    batch = lambda some: pa.RecordBatch.from_arrays([pa.array([r[0] for r in some]), pa.array([r[1] for r in some], pa.large_string())], ["doc_id", "text"])
    monkeypatch.setattr(bm25, "SEGMENT", 100)
    made = list(bm25._segments(3)(iter([batch(rows[a : a + 20]) for a in range(0, 730, 20)])))
    columns = [tuple(m.column(c)[0].as_py() for c in ("ids", "copies", "words", "first", "docs", "tf", "lengths")) for m in made]
    df = collections.Counter()
    for m in bm25._frequencies(iter(made)):
        df.update(dict(zip(m.column("word").to_pylist(), m.column("df").to_pylist(), strict=True)))
    known = np.array(list(df)).view(np.uint64)
    idf = np.array([math.log1p((730 - n + 0.5) / (n + 0.5)) for n in df.values()])
    mean = sum(m.column("total")[0].as_py() for m in made) / 730
    lines = [types.SimpleNamespace(query_id=i, words=w) for m in bm25._asked(3)(iter([batch(rows[::9])])) for i, w, n in zip(*m.to_pydict().values(), strict=True) if n]
    asked = bm25.Asked(lines, known, idf)
    group = bm25.Group(columns, asked, mean)
    assert len(made) == 8 and group.n <= 730 and len(group.dense) >= group.n
    last = np.array([want[q][-1][1] for q in asked.names.tolist()])
    for alone, together, wide, least in ((0.0, 128, 2048, 0 * last), (1.0, 3, 2048, 0 * last), (0.0, 7, 64, last), (1.0, 128, 64, last), (0.03, 128, 2048, last)):
        for name, value in (("ALONE", alone), ("TOGETHER", together), ("WIDE", wide)):
            monkeypatch.setattr(bm25, name, value)
        got = {int(asked.names[q]): list(zip(ids.tolist(), score.tolist(), strict=True)) for q, ids, score in group.search(least, 4)}
        assert got.keys() == want.keys()
        for q, hits in got.items():
            assert [d for d, _ in hits] == [d for d, _ in want[q]]
            assert [x for _, x in hits] == pytest.approx([x for _, x in want[q]], abs=1e-9)


# Two words that a polynomial hash modulo 2**64 can't tell apart, whatever its odd base.
THUE = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
MORSE = THUE.translate(str.maketrans("ab", "ba"))


def test_words_that_collide_under_polynomials(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer("word_bpe_49k.json")
    coder, reference = packing.WordCoder(path), Tokenizer.from_file(path)
    for text in (THUE, MORSE, f"{MORSE} {THUE}"):
        ids, _ = coder.encode(next(textbatch.pieces(pa.array([text])))[2])
        assert ids.tolist() == reference.encode(text, add_special_tokens=False).ids
    df = spark.createDataFrame([(1, f"{THUE}\n{MORSE}"), (2, THUE), (3, MORSE), (4, THUE)], "doc_id long, text string")
    assert {r.doc_id: r.n_dup_lines for r in quality.ledger(df).collect()} == {1: 0, 2: 0, 3: 0, 4: 0}
    assert {r.doc_id: r.component_id for r in neardup.groups(df, 2).collect()} == {1: 1, 2: 2, 3: 3, 4: 2}
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert_best(found(df, df, 4), best_by_force(rows, rows, 4))


def test_memory_tells_equal_hashes_apart(monkeypatch):
    """With a hash that says nothing, bytes alone decide."""
    from graphloom.llm import memory

    monkeypatch.setattr(textbatch.Texts, "hashes", lambda self, start, end, lower=False, key=0: (end - start).astype(np.uint64))
    made = memory.Memory(["u1"], lambda words: [(np.frombuffer(b"".join(w.upper() for w in words), np.uint8), np.array([len(w) for w in words]))], 4)
    for text in ("ab cd ab ef ghi", "cd jkl ghi cd", "", "ab xy z ef ab"):
        for _, _, texts in textbatch.pieces(pa.array([text])):
            start, end, _ = texts.words()
            ((values, size),) = made.look(texts, start, end)
            assert values.tobytes() == text.upper().replace(" ", "").encode() and size.tolist() == [len(w) for w in text.split()]


def test_packing_plan_against_brute_force():
    def fewest(pieces, capacity):
        best = len(pieces)

        def go(at, rooms):
            nonlocal best
            if len(rooms) >= best:
                return
            if at == len(pieces):
                best = len(rooms)
                return
            for r in {*rooms}:
                if r >= pieces[at]:
                    rest = [*rooms]
                    rest.remove(r)
                    go(at + 1, [*rest, r - pieces[at]])
            go(at + 1, [*rooms, capacity - pieces[at]])

        go(0, [])
        return best

    pieces = [2296, 1600, 1248, 1248, 1000, 800]
    assert sum(n for _, n in packing.plan(collections.Counter(pieces))) == fewest(pieces, 4096) == 2
    random.seed(3)
    for _ in range(300):
        capacity = random.randint(10, 40)
        pieces = sorted((random.randint(1, capacity) for _ in range(random.randint(1, 9))), reverse=True)
        counts, rooms = collections.Counter(pieces), []
        for p in pieces:
            room = min((r for r in rooms if r >= p), default=None)
            if room is None:
                rooms.append(capacity - p)
            else:
                rooms[rooms.index(room)] = room - p
        for made in (packing.plan(counts, capacity), packing.best_fit(counts, capacity)):
            used = collections.Counter()
            for chosen, n in made:
                assert sum(chosen) <= capacity
                for s in chosen:
                    used[s] += n
            assert used == counts
            assert fewest(pieces, capacity) <= sum(n for _, n in made) <= len(rooms)
        assert sum(n for _, n in packing.best_fit(counts, capacity)) == len(rooms)
        # the least waste in a room
        sums = {0}
        for p in pieces:
            sums |= {x + p for x in sums}
        chosen = packing.fill(capacity, sorted(counts, reverse=True), counts, 10**6)
        assert sum(chosen) == max(x for x in sums if x <= capacity)


def test_fillings_are_undominated():
    """No piece left over fits in the waste, or in a shorter one's place with it; the search may be cut off anywhere."""
    random.seed(8)
    for _ in range(500):
        room = random.randint(5, 60)
        counts = collections.Counter(random.randint(1, room) for _ in range(random.randint(1, 14)))
        sizes = sorted(counts, reverse=True)
        for effort in (0, 1, 5, None):
            chosen = packing.fill(room, sizes, counts, effort)
            waste, used = room - sum(chosen), collections.Counter(chosen)
            assert waste >= 0 and all(used[s] <= counts[s] for s in used)
            free = [s for s in sizes if used[s] < counts[s]]
            assert not any(t < s <= t + waste for s in free for t in (0, *chosen))
    assert packing.fill(10, [7, 6, 4], {7: 1, 6: 1, 4: 1}, None) == (6, 4)


def test_license_alignment():
    scanner = licenses.Scanner()
    assert [f[0] for f in scanner.scan("word " * 50 + licenses.TEMPLATES["MIT-notice"] + " more" * 40)] == ["MIT-notice"]
    text = "x " * 30 + licenses.TEMPLATES["ISC"].replace("fee", "price") + " y" * 30
    name, share, a, b = scanner.scan(text)[0]
    assert name == "ISC" and 0.9 < share < 1 and text[a:b].startswith("Permission to use")
    assert scanner.scan(None) == [] and scanner.scan("a license of nothing in particular") == []
    a, b = list("abcxdef"), list("abydef")
    assert licenses.align(a, b) == [(0, 0), (1, 1), (4, 3), (5, 4), (6, 5)]


def test_license_repeated():
    """Copies of a notice in a row, at the start, in the middle and at the end of a text."""
    scanner = licenses.Scanner()
    prose = "some words of prose that hold nothing at all "
    for name, notice in licenses.TEMPLATES.items():
        for before, after in (("", ""), ("", prose * 9), (prose * 9, prose * 9), (prose * 9, "")):
            for copies in (1, 2, 3, 5):
                text = before + " ".join([notice] * copies) + " " + after
                got = [f[1:] for f in scanner.scan(text) if f[0] == name]
                bare = notice[: licenses.words(notice)[1][-1][1]]
                assert got == [(1.0, m.start(), m.end()) for m in re.finditer(re.escape(bare), text)][:copies] and len(got) == copies
    damaged = "Licensed under CC BY-NC. Licensed under CC BY-NC 4.0. under CC BY-NC 4.0."
    assert [f[1] for f in scanner.scan(damaged) if f[0].startswith("CC")] == [0.8, 1.0, 0.8]


def test_license_with_a_word_changed():
    scanner = licenses.Scanner()
    for name, notice in licenses.TEMPLATES.items():
        own = notice.split()
        size = len(licenses.words(notice)[0])
        for i in range(len(own)):
            text = " ".join(["license", "zebra " * 40, *own[:i], "qqq", *own[i + 1 :], "zebra " * 40])
            lost = len(licenses.words(own[i])[0])
            if (size - lost) / size >= 0.8:
                assert [f[1] for f in scanner.scan(text) if f[0] == name] == [(size - lost) / size], (name, own[i])
    assert [f[0] for f in scanner.scan("This project is licensed under the MIT License.")] == ["MIT-notice"]


def test_license_without_cue_words():
    scanner = licenses.Scanner()
    assert [f[:2] for f in scanner.scan("Distributed under CC BY-NC 4.0.")] == [("CC-BY-NC-4.0-notice", 0.8)]
    assert [f[:2] for f in scanner.scan("Released under the MIT terms.")] == [("MIT-notice", 0.8)]
    for name in ("MIT", "ISC", "BSD-2-Clause", "GPL-3.0"):
        text = re.sub(r"licen[cs]\w*|permission|redistribution\w*|copyright|sublicense", "qqq", licenses.TEMPLATES[name], flags=re.I)
        assert name in [f[0] for f in scanner.scan(text)], name


def test_license_places_equal_brute_force():
    """As many disjoint places as there are, of at most twice the template's length."""
    random.seed(5)

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    for _ in range(400):
        template = [random.choice("abcde") for _ in range(random.randint(2, 7))]
        own = [random.choice("abcdefg") for _ in range(random.randint(0, 40))]
        least = random.choice([0.5, 0.8, 1.0])
        want, low = 0, 0
        for end in range(1, len(own) + 1):
            start = max(low, end - 2 * len(template))
            if lcs(template, own[start:end]) / len(template) >= least:
                want, low = want + 1, end
        got = licenses.Template(template).places(own, least)
        assert len(got) == want
        for (share, a, b), (_, c, _) in zip(got, [*got[1:], (0, len(own), 0)][: len(got)], strict=True):
            assert least <= share <= lcs(template, own[a : b + 1]) / len(template) and b < c and b - a < 2 * len(template)


def test_warc_round_trip(spark):
    rows = [(1, "http://a/", "same é"), (7, "http://b/", "same é"), (3, None, "same é"), (4, "http://c/\r\n", None), (5, "u", ""), (6, "v", "a\r\n\r\nContent-Length: 3\r\n\r\n"), (6, "v", "a\r\n\r\nContent-Length: 3\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(pages).collect())
    best = {}
    for p, _, h in rows:
        best[h or ""] = max(p, best.get(h or "", 0))
    want = sorted((p, len((h or "").encode()), warc.digest((h or "").encode()), "response" if best[h or ""] == p else "revisit", None if best[h or ""] == p else best[h or ""]) for p, _, h in rows)
    assert [g[:4] for g in got] == [w[:4] for w in want] and [g[4] for g in got] == [w[4] for w in want]


def test_url_labels_of_documents(spark):
    urls = ["http://a.example.com/en/825?page=2", "https://b/x/25#top", "http://c/de/192.html", "http://d/41/", "http://e/fr/7/more", "http://f/12x", None, "no scheme/25"]
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(None, urls[0], "x"), (8, urls[0], "x")], "page_id long, url string, quality string")
    labels = spark.createDataFrame([(825, 0), (825, 1), (25, 1), (192, 1), (41, 0), (7, 0), (12, 0), (None, 0)], "doc_id long, quality int")
    assert sorted(map(tuple, urlrules.by_document(pages, labels).collect())) == [(0, 0), (1, 1), (2, 1), (3, 0), (7, 1), (8, 0)]
    assert urlrules.by_document(pages.limit(0), labels).count() == urlrules.by_document(pages, labels.limit(0)).count() == 0


def test_url_rules_that_shorter_ones_imply():
    random.seed(4)
    for _ in range(200):
        names = {frozenset(random.sample("abcde", random.randint(1, 4))) for _ in range(random.randint(0, 15))}
        rules = [(n, random.choice(["=bad", "=good"]), random.choice([0.6, 0.7, 0.8])) for n in names]
        want = {r for r in rules if not any(o[0] < r[0] and o[1] == r[1] and o[2] >= r[2] for o in rules)}
        assert set(urlrules.pruned(rules)) == want
    index = urlrules.Index([(frozenset(["h:a"]), "=bad", 0.8), (frozenset(["h:a", "p:x"]), "=good", 0.8)])
    assert index.verdict("http://a/x") == "allow" and index.verdict("http://a/y") == "block" and index.verdict(None) == "allow"


def test_url_verdicts_against_every_rule(spark):
    """op6's rows, by trying all rules on every page."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rules = urlrules.mine(pages, urlrules.by_document(pages, spark.read.parquet(f"{SF}/labels.parquet")), support=0.01)
    got = {r.page_id: r for r in urlrules.judge(pages, rules).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        host, path, _ = urlrules.split(r.url)
        rule, verdict = urlrules.fixed(host, path)
        if rule is None:
            own = set(urlrules.tokens(r.url))
            sure = {label: max([c for n, x, c in rules if x == label and n <= own], default=0) for label in ("=bad", "=good")}
            verdict = "block" if sure["=bad"] > sure["=good"] else "allow"
        assert tuple(got[r.page_id]) == (r.page_id, host, path, rule, verdict)


def test_pii_query_against_the_patterns(spark):
    rows = {r.doc_id: r for r in queries.op8_pii(spark, SF).collect()}
    docs = texts_of(spark.read.parquet(f"{SF}/documents.parquet"))
    model = pii.learn(spark.read.parquet(f"{SF}/documents.parquet"))
    assert rows.keys() == docs.keys()
    for i, t in docs.items():
        base = plain_pii(t)
        spelled = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert [rows[i][f"n_{k}"] for k in pii.KINDS[:4]] == [sum(k == x for _, x, _ in base) for k in range(4)]
        assert rows[i].base_sha256 == hashlib.sha256(spelled.encode()).hexdigest()
        every = sorted(base + [(a, k, b) for a, k, b, p in pii.candidates(t, base) if (k, p) in model])
        assert rows[i].spans == ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in every)


def test_pii_secrets_without_digits():
    text = "password: correcthorsebattery and api_key='abcdefgh' key: short token=with1digit99 monkey: businessman"
    found = [text[a:b] for a, _, b, _ in pii.candidates(text, [])]
    assert sorted(found) == ["abcdefgh", "businessman", "correcthorsebattery", "with1digit99"]


def test_columns_of_any_name(spark):
    """Stages keep rows and columns whose names clash with their own, or hold a dot."""
    names = ["doc_id", "a.b", "score", "gone", "n_words", "failed", "text", "c0", "component_id", "labelled"]
    rows = [(i, "x", 0.5, i, 1, 2, f"some words of text number {i} " * 20 + "mail a@b.example", "y", 3, 4) for i in range(6)]
    df = spark.createDataFrame([*rows, rows[2]], names).selectExpr("*")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    for made in (toxicity.accepted(df, labels), neardup.one_each(df), quality.accepted(df), pii.redacted(df)):
        assert made.columns == names
        assert all(r["a.b"] == "x" and r["score"] == 0.5 and r["gone"] == r["doc_id"] and r["c0"] == "y" for r in made.collect())
    assert sorted(r.doc_id for r in neardup.one_each(df).collect()) == [0, 1, 2, 3, 4, 5] and toxicity.accepted(df, labels).count() == 7
    same = df.withColumn("text", F.lit("one two three four five six seven")).union(df.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    assert sorted(str(r.doc_id) for r in neardup.one_each(same).collect()) == ["0", "None"]
    for made in (queries.packing.pack(df, queries.tokenizer("word_bpe_49k.json")), quality.ledger(df), licenses.scan(df), pii.spans(df), neardup.groups(df), pieces.digests(df, queries.tokenizer("piece_bpe_32k.model"))):
        assert made.count() == 7
    pages = df.withColumnsRenamed({"doc_id": "page_id", "a.b": "url", "text": "html"})
    assert warc.round_trip(pages).count() == 7 and urlrules.judge(pages, []).count() == 7


def test_empty_tables(spark, documents):
    none, path = documents.limit(0), queries.tokenizer("word_bpe_49k.json")
    pages = spark.read.parquet(f"{SF}/pages.parquet").limit(0)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    made = [packing.pack(none, path), quality.ledger(none), quality.accepted(none), toxicity.accepted(none, labels), licenses.scan(none), pii.spans(none), pii.redacted(none), neardup.groups(none), neardup.one_each(none), pieces.digests(none, queries.tokenizer("piece_bpe_32k.model")), urlrules.judge(pages, []), warc.round_trip(pages)]
    assert [m.count() for m in made] == [0] * len(made)


def test_a_long_text(spark):
    """Five million characters, and a word of one million, in every operator on texts."""
    text = " ".join(f"w{i % 90_000}" for i in range(800_000)) + " " + "y" * 1_000_000 + "\nmail me@site.example. Released under the MIT License."
    df = spark.createDataFrame([(1, text), (2, text), (3, "short")], "doc_id long, text string")
    made = packing.pack(df, queries.tokenizer("word_bpe_49k.json")).collect()
    tokens = sum(r.length for r in made if r.doc_id == 1)
    assert tokens == sum(r.length for r in made if r.doc_id == 2) > 800_000 and max(r.length for r in made) == 4096
    assert {r.doc_id: r.n_words for r in quality.ledger(df).collect()} == {1: 800_008, 2: 800_008, 3: 1}
    assert {r.doc_id: r.component_id for r in neardup.groups(df).collect()} == {1: 1, 2: 1, 3: 3}
    assert {r.doc_id: [x.kind for x in r.found] for r in pii.spans(df).collect()}[1][:1] == ["email"]
    assert {r.doc_id: [x.license for x in r.licenses] for r in licenses.scan(df).collect()} == {1: ["MIT-notice"], 2: ["MIT-notice"], 3: []}
    assert [(r.rank, r.doc_id) for r in bm25.search(df, df.where("doc_id = 2"), 2).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    got = {r.doc_id: (r.n_tokens, r.spans_sha256) for r in pieces.digests(df, queries.tokenizer("piece_bpe_32k.model")).collect()}
    assert got[1] == got[2] and got[1][0] > 800_000


def test_pipeline_stages_against_brute_force(spark):
    """Each stage, on what the one before kept."""
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    of = lambda df: {r.doc_id: r for r in df.collect()}
    model = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    before = of(docs)
    rows = stages["toxicity"](spark, docs, SF)
    score = {i: float(toxicity.score(next(textbatch.pieces(pa.array([r.text or ""])))[2], model)[0]) for i, r in before.items()}
    assert of(rows) == {i: r for i, r in before.items() if score[i] < 0.5} and rows.columns == docs.columns
    docs, before = rows, of(rows)

    rows = stages["quality"](spark, docs, SF)

    def good(t):
        w, lines = words(t), [x for x in t.split("\n") if words(x)]
        three = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {i + j for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for j in range(3)}
        chars = sum(map(len, w))
        return len(w) >= 50 and 100 * len(covered) <= 50 * len(w) and 100 * len(re.findall(r"[#*$%&|<>]", t)) <= 10 * len(w) and 2 * len(w) <= chars <= 20 * len(w) and 100 * (len(lines) - len(set(lines))) <= 30 * len(lines)

    assert of(rows) == {i: r for i, r in before.items() if good(r.text or "")}
    docs, before = rows, of(rows)

    rows = stages["near_dedup"](spark, docs, SF)
    assert of(rows) == {i: before[i] for i, (_, least) in groups_by_force({i: r.text or "" for i, r in before.items()}, 5, 80).items() if i == least}
    docs, before = rows, of(rows)

    rows = stages["pii"](spark, docs, SF)
    model = pii.learn(docs)
    want = {}
    for i, r in before.items():
        text, at = "", 0
        for a, k, b in sorted(plain_pii(r.text) + [(a, k, b) for a, k, b, p in pii.candidates(r.text, pii.base(r.text)) if (k, p) in model]):
            text += r.text[at:a] + f"[{pii.KINDS[k].upper()}]" if a >= at else ""
            at = max(at, b)
        want[i] = text + r.text[at:]
    assert {i: r.text for i, r in of(rows).items()} == want and rows.columns == docs.columns

    from tokenizers import Tokenizer

    packed = stages["packing"](spark, rows, SF).collect()
    coder = Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json"))
    ids = collections.defaultdict(list)
    for r in sorted(packed, key=lambda r: (r.doc_id, r.piece)):
        ids[r.doc_id] += r.ids
    assert ids == {i: [*coder.encode(t, add_special_tokens=False).ids, 1] for i, t in want.items()}
    ends = collections.Counter()
    for r in sorted(packed, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 4096 and len(ends) < 1.05 * sum(ends.values()) / 4096 + 1


def test_pipeline(spark):
    rows = corpus_pipeline.run(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert rows.select("doc_id").distinct().count() <= docs.count() and rows.where(F.size("ids") != F.col("length")).count() == 0


def test_worker_memory(spark):
    """One operator's cache at a time; a batch's bound is set only over Spark's own."""
    from graphloom.llm import workers

    made = workers.hold("a", list)
    assert workers.hold("a", dict) is made
    workers.hold("b", dict)
    assert list(workers._held) == ["b"]
    workers.forget()
    assert not workers._held
    docs = spark.range(20).selectExpr("id AS doc_id", "repeat('word ', 200000) AS text")
    spark.conf.unset(workers.BATCH)

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    most = max(r.n for r in workers.by_batch(docs.coalesce(1), sizes, "n long").collect())
    assert most < 2 * workers.MOST
    spark.conf.set(workers.BATCH, "1m")
    workers.by_batch(docs, sizes, "n long")
    assert spark.conf.get(workers.BATCH) in ("1m", "1048576b")
    spark.conf.unset(workers.BATCH)
