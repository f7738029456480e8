"""Operators on Spark against SQL or brute force, with nulls, empty, long and repeated rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import same
from conftest import SF
from pyspark.sql import functions as F

from paperloom.llm import bpe, decontaminate, exact_dedup, langid, minhash, pii, quality, queries, substrings, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, node string, row long, id long, __row string, __t long, __words long, __sha string, sha long, Own long, worded long"


def docs_of(spark, rows):
    """Documents with further columns of names that operators use within."""
    return spark.createDataFrame([(i, t, "en", None, None, True, "x", 1, 2, "r", 3, 4, "s", 5, 6, 7) for i, t in rows], SCHEMA)


LONG = " ".join(f"w{i}" for i in range(60_000))
EDGE = [(1, None), (2, ""), (3, " \t"), (4, "one two"), (4, "one two"), (5, "one  two"), (None, "one two"), (None, None), (6, LONG), (7, LONG), (8, "x"), (9, "é" * 300)]


@pytest.mark.parametrize("name", ["op5_exact_dedup", "op7_warc_chunks"])
def test_against_sql(spark, sql, name):
    same(queries.QUERIES[name](spark, SF), sql, queries.ORACLES[name])


def test_exact_dedup_edges(spark):
    got = exact_dedup.decisions(docs_of(spark, EDGE)).collect()
    assert len(got) == len(EDGE) and sum(r["kept"] for r in got) == 6
    assert Counter((r["keep_id"], r["group_size"]) for r in got if r["kept"])[(4, 4)] == 1
    assert exact_dedup.decisions(docs_of(spark, EDGE).where("false")).count() == 0
    out = exact_dedup.drop_copies(docs_of(spark, EDGE))
    assert out.columns == docs_of(spark, EDGE).columns and sorted((r["doc_id"], r["text"]) for r in out.collect()) == [(1, None), (3, " \t"), (4, "one two"), (6, LONG), (8, "x"), (9, "é" * 300)]


def shingles(text, size):
    """A text's shingles as they are, without hashes."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = min(size, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


@pytest.mark.parametrize("group", [256, 3])
def test_near_dedup_families(spark, monkeypatch, group):
    monkeypatch.setattr(minhash, "GROUP", group)  # 3: stars within stars
    monkeypatch.setattr(minhash, "EDGES", 5)
    rnd = random.Random(5)
    rows = []
    for _ in range(4):
        base = [f"w{rnd.randint(0, 4000)}" for _ in range(100)]
        for _ in range(40):
            t = list(base)
            for _ in range(rnd.choice([0, 1, 2, 3, 5, 8])):
                t[rnd.randrange(len(t))] = f"x{rnd.randint(0, 3000)}"
            rows.append((len(rows), " ".join(t)))
            if rnd.random() < 0.2:
                t[rnd.randrange(len(t))] = "zz"
                rows.append((len(rows), " ".join(t)))
    sets = [shingles(t, 4) for _, t in rows]
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r["doc_id"]: r["component_id"] for r in minhash.clusters(docs_of(spark, rows), 4).collect()}
    assert got == {i: find(i) for i in range(len(rows))}


def test_near_dedup_edges(spark):
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash.clusters(docs_of(spark, EDGE), 4).collect()), key=str)
    assert got.count((4, 1, 4)) == 2 and (5, 1, 4) in got and (None, 1, 4) in got and (1, 0, 1) in got and (3, 0, 3) in got and (7, 59_997, 6) in got
    kept = minhash.drop_near_copies(docs_of(spark, EDGE))
    assert kept.columns == docs_of(spark, EDGE).columns and Counter(r["doc_id"] for r in kept.collect()) == Counter([1, 2, 3, 4, None, 6, 8, 9])
    assert minhash.clusters(docs_of(spark, EDGE).where("false")).count() == 0


def test_near_dedup_keeps_one_row_of_each_component(spark):
    rows = [(None, "red apples fall in autumn"), (None, "seven ships sail north"), (None, "seven ships sail north"), (5, "one id with this text"), (5, "and another wholly unlike text"), (6, "and another wholly unlike text")]
    kept = minhash.drop_near_copies(docs_of(spark, rows))
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter(rows[i] for i in (0, 1, 3, 4))


def brute_spans(rows, length=200):
    raws = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p : p + length] for _, b in raws for p in range(len(b) - length + 1))
    out = []
    for i, b in raws:
        mask = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p : p + length]] > 1:
                mask[p : p + length] = b"\1" * length
        out.append((i, len(b), sum(mask), sum(1 for k in range(len(b)) if mask[k] and (not k or not mask[k - 1])), bytes(c for c, m in zip(b, mask) if not m)))
    return sorted(out, key=str)


def test_repeats_against_brute_force(spark):
    rnd = random.Random(2)
    noise = lambda n: "".join(rnd.choice("abcdefgh é") for _ in range(n))
    passage, exact = noise(260), noise(200)
    rows = [(1, noise(400) + passage + noise(300)), (2, passage), (3, noise(90) + passage[:230] + noise(80)), (4, exact + "q"), (5, "p" + exact), (6, "ab" * 300), (7, noise(150) + "ab" * 120), (8, None), (9, ""), (10, noise(199)), (11, "z" * 199), (12, "z" * 200), (13, "y" * 201)]
    rows += [(20, noise(500))] * 2 + [(21, passage[:100] + "X" + passage[101:])]
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_bytes"] - len(r["kept"]), len(r["spans"]), bytes(r["kept"])) for r in substrings.remove_repeats(docs_of(spark, rows)).collect()), key=str)
    assert got == brute_spans(rows)
    assert substrings.remove_repeats(docs_of(spark, rows).where("false")).count() == 0


def test_warc_edges(spark):
    big = "y" * 1500
    rows = [(1, "u", None), (2, None, ""), (3, "u", big), (5, "u", big), (4, "u", big), (5, "u", big), (None, "u", big), (6, "u", "short"), (7, "u", "short"), (8, "u", "é" * 100_000)]
    table = warc.through_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), chunk=4096)
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in table.where("last").collect()), key=str)
    assert got == sorted([(1, 0, "response", None), (2, 0, "response", None), (3, 1500, "revisit", 5), (4, 1500, "revisit", 5), (5, 1500, "response", None), (5, 1500, "response", None), (None, 1500, "revisit", 5), (6, 5, "response", None), (7, 5, "response", None), (8, 200_000, "response", None)], key=str)
    assert table.where("page_id = 8").count() == 49


def test_leaks(spark):
    item = "A train leaves town with 12 wagons and reaches the far coast after 5 hours on the old line while 12 people wait"
    bench = spark.createDataFrame([(1, item), (2, None), (3, "two words"), (4, "seven plain words stand here all alone")], "item_id long, text string")
    other = item.replace("12", "37").replace(" 5 ", " 8 ")
    torn = item.replace("12 wagons", "37 wagons")
    rows = [(1, f"noise before, {item.upper()} noise"), (2, f"some {other} more"), (3, f"some {torn} more"), (4, "clean words of another kind " * 9), (5, None), (6, ""), (7, "so seven plain words stand here all alone then"), (None, item)]
    got = {(r["doc_id"], r["item_id"]): r["exact"] for r in decontaminate.leaks(docs_of(spark, rows), bench).collect()}
    assert got == {(1, 1): True, (2, 1): False, (7, 4): True, (None, 1): True}
    kept = decontaminate.drop_leaks(docs_of(spark, rows), bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6] and kept.columns == docs_of(spark, rows).columns
    assert decontaminate.leaks(docs_of(spark, rows), bench.where("false")).count() == 0 and decontaminate.leaks(docs_of(spark, rows).where("false"), bench).count() == 0


def leaked(spark, items, texts):
    found = decontaminate.leaks(docs_of(spark, enumerate(texts)), spark.createDataFrame(items, "item_id long, text string")).collect()
    return sorted(((r["doc_id"], r["item_id"], r["coverage"]) for r in found), key=str)


def test_leaks_in_other_context_and_case(spark):
    planet, train = "Which planet is the largest in the solar system?", "Trains leave Berlin with 12 wagons each day now"
    texts = [f"Here is a quiz question\n{planet}", planet.lower(), f"see;{planet.upper()}so", f"we read, {train.replace('12', '31')}", f"we read, {train.replace('Trains', 'Buses').replace('12', '31')}", "which planet is the smallest"]
    assert leaked(spark, [(1, planet), (2, train)], texts) == [(0, 1, 1.0), (1, 1, 1.0), (2, 1, 1.0), (3, 2, 1.0)]


def test_leaks_of_items_rich_in_numbers(spark):
    item = "What is 12 + 35 + 48 + 17 + 20 + 3 + 9?"
    assert leaked(spark, [(1, item)], [f"Now: {item} Well.", item.replace("48", "49")]) == [(0, 1, 1.0)]


def test_leaks_of_repeated_and_nameless_items(spark):
    short, other = "seven plain words stand here all alone today", "quite another question stands under the same number"
    got = leaked(spark, [(1, short), (1, short), (1, other), (None, "nobody gave this passage any number at all")], [f"so {short}", f"and {other} too", "say nobody gave this passage any number at all"])
    assert got == [(0, 1, 1.0), (1, 1, 1.0), (2, None, 1.0)]


def test_leaks_of_short_items_and_scripts_without_spaces(spark):
    chinese, thai = "太阳系中最大的行星是哪一颗", "ดาวเคราะห์ดวงใดใหญ่ที่สุด"
    texts = ["What is the capital?", "Quiz: what is the capital? Say it", "what is the new capital", f"请回答{chinese}？谢谢", f"ถาม{thai}ครับ", "太阳系中最小的行星"]
    assert leaked(spark, [(1, "What is the capital?"), (2, chinese), (3, thai)], texts) == [(0, 1, 1.0), (1, 1, 1.0), (3, 2, 1.0), (4, 3, 1.0)]


def test_verbatim_items_are_found(spark, sql):
    want = set(sql.execute("SELECT doc_id, item_id FROM documents d, benchmark b WHERE contains(d.text, b.text)").fetchall())
    got = {(r["doc_id"], r["item_id"]) for r in queries.QUERIES["op2_template_decontamination"](spark, SF).collect()}
    assert want and want <= got and len(got - want) <= 2


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary())


def test_tokens_and_shards(spark, sql, library):
    texts = sql.execute("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()
    three = {r["doc_id"]: r for r in queries.QUERIES["op3_bpe_prefix_dp"](spark, SF).collect()}
    four = {r["doc_id"]: r for r in queries.QUERIES["op4_token_sst"](spark, SF).collect()}
    at = 0
    for i, t in texts:
        ids = library.encode(t or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        assert (three[i]["n_tokens"], three[i]["ids_sha256"], three[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert (four[i]["start"], four[i]["n_tokens"], four[i]["ids_crc32"]) == (at, len(ids) + 1, zlib.crc32(raw + b"\2\0\0\0"))
        at += len(ids) + 1


def test_shard_edges(spark):
    from paperloom.llm import sst

    back = sst.through_shards(docs_of(spark, EDGE), queries.vocabulary()).orderBy("start").collect()
    assert [r["doc_id"] for r in back] == [None, None, 1, 2, 3, 4, 4, 5, 6, 7, 8, 9] and back[0]["start"] == 0
    assert sst.through_shards(docs_of(spark, EDGE).where("false"), queries.vocabulary()).count() == 0


def test_held_out_language_and_quality(spark, sql):
    lang = dict(sql.execute("SELECT doc_id, lang FROM documents").fetchall())
    found = [r for r in queries.QUERIES["op6_language_crf"](spark, SF).collect()]
    assert len(found) == len(lang) and np.mean([lang[r["doc_id"]] == r["lang_pred"] for r in found if r["held_out"]]) > 0.9
    label = dict(sql.execute("SELECT doc_id, quality FROM labels").fetchall())
    scored = queries.QUERIES["op1_quality_compression"](spark, SF).collect()
    assert len(scored) == len(lang) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in scored)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in scored)


def test_quality_ranks_and_is_calibrated(spark):
    """Held-out rows of the larger tables: a constant would rank at 0.5."""
    sf = "/root/testdata/sf0.01"
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    held = [(r["score"], label[r["doc_id"]]) for r in queries.QUERIES["op1_quality_compression"](spark, sf).where("held_out").collect() if label.get(r["doc_id"]) is not None]
    good, bad = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert len(good) > 20 and len(bad) > 5
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.85
    assert abs(np.mean([s for s, _ in held]) - np.mean([y for _, y in held])) < 0.1
    assert np.mean([(s - y) ** 2 for s, y in held]) < 0.8 * np.mean(label_share(held))


def label_share(held):
    """Squared errors of the best constant."""
    share = np.mean([y for _, y in held])
    return [(share - y) ** 2 for _, y in held]


def test_samples_are_bounded(spark, monkeypatch):
    """Very many rows of one id, the same or different ones, and the same texts under a few languages."""
    monkeypatch.setattr(langid, "LANGS", 3)
    rows = spark.range(20_000).selectExpr("cast(if(id % 2 = 0, 7, id) AS long) AS doc_id", "if(id % 4 = 0, 'the same text again', concat('words of text ', id)) AS text", "concat('l', id % 4) AS lang")
    seen = []
    monkeypatch.setattr(langid, "fit", lambda texts, langs: seen.append(Counter(langs)))
    langid.fit_on(rows, 50)
    assert set(seen[0]) <= {"l0", "l1", "l2", "l3"} and len(seen[0]) == 3 and max(seen[0].values()) <= 50
    monkeypatch.setattr(quality, "fit", lambda texts, labels, prior: seen.append(len(texts)))
    labels = spark.range(60).selectExpr("id AS doc_id", "cast(id % 2 AS int) AS quality")
    quality.fit_on(rows, labels, 20)
    assert seen[1] <= 40


def test_models_with_edge_rows(spark):
    """Null, empty, long and repeated rows, and empty tables, through the models and the encoder."""
    docs, vocabulary = docs_of(spark, EDGE), queries.vocabulary()
    nothing, labels = docs.where("false"), spark.createDataFrame([(1, 1), (4, 0), (4, 1), (None, 1)], "doc_id long, quality int")
    for fitted in (quality.fit_on(docs, labels), quality.fit_on(nothing, labels.where("false"))):
        got = quality.score(docs, fitted).collect()
        assert len(got) == len(EDGE) and all(0 <= r["score"] <= 1 for r in got) and quality.score(nothing, fitted).count() == 0
    for fitted in (langid.fit_on(docs), langid.fit_on(nothing)):
        got = Counter((r["doc_id"], r["lang_pred"]) for r in langid.identify(docs, fitted).collect())
        assert sum(got.values()) == len(EDGE) and got[(1, "und")] == got[(2, "und")] == got[(3, "und")] == got[(None, "und")] / (1 if fitted.langs else 2) == 1
        assert langid.identify(nothing, fitted).count() == 0 and langid.keep_identified(nothing, fitted).count() == 0
    ids = Counter((r["doc_id"], len(r["ids"]) // 4) for r in bpe.encode(docs, vocabulary).collect())
    assert sum(ids.values()) == len(EDGE) and ids[(1, 0)] == ids[(2, 0)] == ids[(3, 0)] == ids[(None, 0)] == 1 and ids[(4, 2)] == 2 and bpe.encode(nothing, vocabulary).count() == 0


def test_reparameterised_items_are_found(spark):
    """Items asked again with other numbers and names: at least 0.9 of them, and no item of a torn slot."""
    rnd = random.Random(11)
    plain = [w for w in ("river stone garden window market signal copper winter letter engine valley harbour mirror thunder carpet velvet saddle lantern meadow orchard").split()]
    people = ["Anna", "Bruno", "Clara", "David", "Elena", "Felix"]

    def item():
        words = [rnd.choice(plain) for _ in range(18)]
        for at in rnd.sample(range(2, 17), 3):
            words[at] = str(rnd.randint(10, 99))
        words[9] = rnd.choice(people)
        return words

    items = [item() for _ in range(40)]

    def again(words):
        change = {}
        return [change.setdefault(w, str(rnd.randint(100, 999))) if w.isdigit() else rnd.choice(people) if w in people else w for w in words]

    texts = [" ".join([*[rnd.choice(plain) for _ in range(12)], *again(w), *[rnd.choice(plain) for _ in range(12)]]) for w in items]
    got = leaked(spark, [(i, " ".join(w) + ".") for i, w in enumerate(items)], texts)
    assert len({(d, i) for d, i, _ in got if d == i}) >= 36 and all(d == i for d, i, _ in got)


def test_items_of_several_lengths_in_one_pass(spark):
    items = [(n, " ".join(f"it{n}w{k}" for k in range(n))) for n in range(1, 12)]
    texts = ["before " + t + " behind" for _, t in items]
    assert leaked(spark, items, texts) == sorted(((n - 1, n, 1.0) for n in range(1, 12)), key=str)


@pytest.mark.parametrize("size", [5, 20, 100, 700])
def test_banding_finds_pairs_at_the_threshold(size):
    """Pairs of sets with a similarity of 0.8 or just above share a band."""
    rng, missed = np.random.default_rng(size), 0
    for _ in range(300):
        both = -(-8 * size // 10)
        every = rng.integers(0, 2**63, 2 * size - both).astype(np.uint64) * np.uint64(2)
        a, b = every[:size], np.concatenate([every[:both], every[size:]])
        if len(np.intersect1d(a, b)) < 0.8 * len(np.union1d(a, b)):
            b = np.concatenate([a[: -(-9 * size // 10)], every[size : size + size // 10]])
        keys = [set(minhash.band_keys(minhash.signature(np.unique(x))).tolist()) for x in (a, b)]
        missed += not keys[0] & keys[1]
    assert missed == 0


def test_texts_stay_where_no_language_can_be_learnt(spark):
    import corpus_pipeline as c

    docs = docs_of(spark, EDGE + [(10, "12 + 3 =")]).withColumn("lang", F.lit(None).cast("string"))
    kept = c.language(spark, docs, SF)
    assert kept.columns == docs.columns and Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter(r for r in EDGE if (r[1] or "").strip())


def test_pseudonym_rows(spark):
    """Equal values stay linked across documents, different ones apart; what isn't found stays; the key brings all back."""
    key = b"key of these tests"
    card, mail, day = "4111 1111 1111 1111", "ann.lee@mail.example.com", "2012-03-04"
    rows = EDGE + [(20, f"paid by {card} on {day}"), (21, f"{mail} wrote: {card}"), (22, f"{mail}, {mail} and bob.lee@mail.example.com"), (22, f"{mail}, {mail} and bob.lee@mail.example.com"), (23, LONG + f" {day}")]
    got = pii.pseudonyms(docs_of(spark, rows), key).collect()
    assert sorted((str(r["doc_id"]), str(pii.pseudonymise(r["text"], key, True)[0])) for r in got) == sorted((str(i), str(t)) for i, t in rows)
    assert sorted(str((r["doc_id"], r["text"])) for r in got if not r["found"]) == sorted(str(r) for r in EDGE)
    by = {r["doc_id"]: r for r in got if r["found"]}
    spans = {i: [by[i]["text"][f["start"] : f["end"]] for f in by[i]["found"]] for i in (20, 21, 22)}  # pseudonyms keep their lengths
    assert spans[20][0] == spans[21][1] != card and spans[21][0] == spans[22][0] == spans[22][1] != spans[22][2] and mail not in str(spans)
    assert by[23]["text"].startswith(LONG) and by[23]["text"].endswith(spans[20][1])
    assert pii.pseudonyms(docs_of(spark, rows).where("false"), key).count() == 0


def test_pipeline_against_brute_force(spark, sql, library):
    import corpus_pipeline as c

    assert c.ORACLE_SQL is None and [n for n, _ in c.STAGES] == ["language", "exact", "near", "decontaminated", "tokens"]
    docs = {i: t for i, t in sql.execute("SELECT doc_id, text FROM documents").fetchall() if t and any(map(str.isalpha, t))}
    first = {}
    for i in sorted(docs):
        first.setdefault(" ".join(docs[i].replace("\x0b", " ").replace("\x0c", " ").split()), i)
    kept = sorted(first.values())
    sets = {i: shingles(docs[i], 5) for i in kept}
    root = {i: i for i in kept}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for x, i in enumerate(kept):
        for j in kept[:x]:
            if 100 * min(len(sets[i]), len(sets[j])) >= 80 * max(len(sets[i]), len(sets[j])):
                n = len(sets[i] & sets[j])
                if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                    a, b = find(i), find(j)
                    root[max(a, b)] = min(a, b)
    kept = [i for i in kept if find(i) == i]
    items = [t for (t,) in sql.execute("SELECT text FROM benchmark").fetchall()]
    clean = {i for i in kept if not any(t in docs[i] for t in items)}
    got = {r["doc_id"]: r["n_tokens"] for r in c.run(spark, SF).collect()}
    assert set(got) <= clean and len(clean - set(got)) <= 2
    assert all(got[i] == len(library.encode(docs[i], add_special_tokens=False).ids) for i in got)
