"""Near duplicates and components against all pairs; archives against their pages."""

import base64
import hashlib
import random
from itertools import combinations

import pytest

from seqspark.llm import near_dup, warc
from seqspark.llm.common import written
from seqspark.llm.components import components


def brute(rows, width, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnopqr") + rng.choice("stuvwxyz")
    passage = [word() for _ in range(30)]
    texts = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 8, 40, 120]))]
        for _ in range(rng.choice([1, 2, 15])):
            edited = [word() if rng.random() < rng.choice([0, 0.01, 0.03, 0.06]) else w for w in base]
            texts.append(" ".join(edited))
    texts += [" ".join([word() for _ in range(25)] + passage) for _ in range(25)]
    texts += ["", None, " \n", "one", "ONE", "one two", texts[0], texts[0].upper()]
    rows = [(100 - i if i % 3 else 1000 + i, t) for i, t in enumerate(texts)]
    return [*rows, rows[2], (None, texts[1]), (None, None)]


def test_one_survivor_of_each_component(spark):
    a, b = (" ".join(f"{p}{i}" for i in range(60)) for p in "ab")
    near, c = a + " more", "some other words that nothing else has"
    rows = [(None, a), (None, a), (None, near), (5, b), (None, b), (3, b + " end"), (3, c), (7, c), (7, a + " twice"), (None, "lone text"), (None, "lone  TEXT"), (None, " "), (None, None), (9, ""), (9, "")]
    kept = near_dup.survivors(spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, cls string"))
    assert kept.columns == ["doc_id", "text", "cls"]
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert sum(x[1] in ("lone text", "lone  TEXT") for x in got) == 1
    assert sorted((x for x in got if x[1] not in ("lone text", "lone  TEXT")), key=str) == sorted([(7, a + " twice"), (3, b + " end"), (3, c), (None, " "), (None, None), (9, ""), (9, "")], key=str)
    nameless = near_dup.survivors(spark.createDataFrame([(None, a), (None, a), (None, near)], "doc_id long, text string"))
    assert nameless.count() == 1


@pytest.mark.parametrize("seed,width,block,percent,sketch", [(2, 5, 1024, 80, 32), (3, 4, 4, 80, 32), (4, 4, 1024, 50, None)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, seed, width, block, percent, sketch):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    monkeypatch.setattr(near_dup, "PAIRED", 1 if block == 4 else 16)
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, cls string")
    got = near_dup.near_duplicates(df, width=width, percent=percent, sketch=sketch).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows, width, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_values_asked_for():
    assert [near_dup.needed(p, 32) for p in (50, 80, 100)] == [2, 12, 32]
    with pytest.raises(ValueError):
        near_dup.near_duplicates(None, percent=0)


def test_rows_without_ids(spark):
    """Many copies and near copies without an id: linear, each class once."""
    long = " ".join(f"w{i}" for i in range(40_000))
    rows = [(None, f"a{i // 2} b{i // 2} c{i // 2} d{i // 2} e{i // 2} f{i // 2} g{i // 2} h{i // 2} j{i // 2} k{i // 2} l{i // 2} m{i // 2}" + (" end" if i % 2 else "")) for i in range(1500)] + [(None, "the same words again and again here")] * 3000 + [(5, long), (None, long + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dup.near_duplicates(df, width=4, percent=80)
    assert got.where("doc_id is null and component_id = 5").count() == 1 and got.count() == len(rows)
    assert near_dup.survivors(df, width=4, percent=80).count() == 750 + 1 + 1


def test_no_documents(spark):
    assert near_dup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_chain(spark):
    from seqspark.llm.common import scratch

    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 101)], "u long, v long")
    got = dict(components(edges, scratch(spark, "test")).collect())
    assert {got[i] for i in range(41)} == {0} and got[101] == got[100] == 100


def test_archives(spark):
    pages = [(1, "http://a", "<p>é</p>"), (5, None, "<p>é</p>"), (3, "http://c", "<p>é</p>"), (4, "http://d\r\nX: y", ""), (2, "http://b", None), (7, "http://e", "x" * 100_000), (None, "http://f", "<p>é</p>"), (None, "http://g", "alone"), (9, "u", "WARC/1.1\r\n\r\n")]
    index = warc.write_archives(spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string"))
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_records(index).collect()}
    expected = set()
    for i, _, html in pages:
        data = (html or "").encode()
        same = [j for j, _, h in pages if (h or "").encode() == data and j is not None]
        newest = max(same, default=None)
        kind = "revisit" if newest is not None and i != newest else "response"
        expected.add((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), kind, newest if kind == "revisit" else None))
    assert got == expected
    some = warc.read_records(index.where("page_id in (1, 7)")).collect()
    assert {r.page_id: r.payload and len(r.payload) for r in some} == {1: None, 7: 100_000}
    raised = warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"), least_bytes=50)
    assert raised.where("record_type = 'revisit'").count() == 0
    assert warc.read_records(warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


def _counted(check, path):
    """``check`` that notes the rows it is given in files of ``path``."""

    def run(batches):
        import uuid

        n = 0

        def seen():
            nonlocal n
            for b in batches:
                n += b.num_rows
                yield b

        yield from check(seen())
        with open(f"{path}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(n))

    return run


def test_rows_of_a_large_group_grow_with_its_members(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    monkeypatch.setattr(near_dup, "PAIRED", 1)
    rng, dealt = random.Random(2), {}
    base = [f"w{i}" for i in range(300)]
    exact, rough = near_dup._exact, near_dup._rough
    for n in (160, 320, 640):
        rows = []
        for k in range(n):
            words = list(base)
            words[rng.randrange(300)] = f"x{k}"
            rows.append((k, " ".join(words)))
        for name, make in (("exact", exact), ("rough", rough)):
            folder = tmp_path / f"{name}-{n}"
            folder.mkdir()
            monkeypatch.setattr(near_dup, f"_{name}", lambda *a, make=make, folder=str(folder): _counted(make(*a), folder))
        got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4, percent=80).collect()
        assert {r.component_id for r in got} == {0}
        dealt[n] = [sum(int(f.read_text()) for f in (tmp_path / f"{name}-{n}").iterdir()) for name in ("exact", "rough")]
    for i in (0, 1):
        assert dealt[320][i] < 2.6 * dealt[160][i] and dealt[640][i] < 2.6 * dealt[320][i], dealt
    assert dealt[640][0] < 4 * 640, dealt


def executed(spark):
    """The final plan of the last query."""
    store = spark._jsparkSession.sharedState().statusStore()
    runs = store.executionsList()
    return runs.apply(runs.size() - 1).physicalPlanDescription()


def test_pages_of_one_digest_are_split(spark, monkeypatch):
    """A third of all pages are alike: without a broadcast their partition is split, and no page is lost."""
    small = {"spark.sql.shuffle.partitions": "24", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k"}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        pages = spark.range(0, 6000, 1, 12).selectExpr("id page_id", "concat('http://', sha2(cast(id as string), 512)) url", "case when id % 3 = 0 then repeat('same ', 60) else concat(sha2(cast(id as string), 512), sha2(cast(id + 1 as string), 512)) end html")
        plans = []
        monkeypatch.setattr(warc, "written", lambda df, path: (out := written(df, path), plans.append(executed(spark)))[0])
        index = warc.write_archives(pages)
        kinds = dict(index.groupBy("record_type").count().collect())
    finally:
        for k in small:
            spark.conf.unset(k)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert "skew=true" in plans[-1].lower() or "isskew" in plans[-1].lower() or "skewed" in plans[-1].lower(), plans[-1][:3000]
    assert kinds == {"response": 4001, "revisit": 1999}
