"""Queries without SQL against plain loops over their inputs."""

import __spark_entry__ as entry
from larkspine.plans import queries_retrieval as q
from larkspine.plans.base import Tables

QUERIES = entry.queries()


def words(text):
    return set((text or "").lower().split())


def plain_mmr(hits, k, lam):
    """Each step looks at all that is left against all that is chosen."""
    left, chosen = sorted(hits, key=lambda h: (-h["score"], h["doc_id"]))[: 2 * k], []
    while left and len(chosen) < k:
        def worth(h):
            near = [len(words(h["text"]) & words(c["text"])) / max(1, len(words(h["text"]) | words(c["text"]))) for c in chosen]
            return lam * h["score"] / 10 - (1 - lam) * max(near, default=0.0)

        best = max(left, key=worth)  # of equal ones the first
        chosen.append(best)
        left.remove(best)
    return [(h["query_id"], h["doc_id"], h["score"], i + 1) for i, h in enumerate(chosen)]


def groups(spark, data):
    by = {}
    for r in q.hits_with_text(Tables(spark, data)).collect():
        by.setdefault(r["query_id"], []).append(r)
    return by


def rows(df):
    return sorted(map(tuple, df.select("query_id", "doc_id", "score", "mmr_rank").collect()))


def test_mmr(spark, data):
    want = [r for hits in groups(spark, data).values() for r in plain_mmr(hits, 10, 0.5)]
    assert rows(QUERIES["r25_mmr_diverse"](spark, data)) == sorted(want) and want


def test_diverse(spark, data):
    want = [r for hits in groups(spark, data).values() for r in plain_mmr(hits, 5, 0.7)]
    assert rows(QUERIES["r30_diverse_search"](spark, data)) == sorted(want)


def plain_pack(text, size, overlap, separator):
    strip = lambda p: p.strip("".join(map(chr, range(33))))
    out, held, n, sep = [], [], 0, len(separator)
    for p in filter(None, map(strip, (text or "").split(separator))):
        if len(p) > size:
            out += [separator.join(held)] if held else []
            step = size - overlap
            out += [p[i * step : i * step + size] for i in range(max(0, -(-(len(p) - size) // step)) + 1)]
            held, n = [], 0
        elif held and n + len(p) + sep > size:
            out.append(separator.join(held))
            back, m = [], 0
            for x in reversed(held):
                if back and m >= overlap:
                    break
                back.insert(0, x)
                m += len(x) + sep
            held, n = [*back, p], m + len(p) + sep
        else:
            held.append(p)
            n += len(p) + sep
    return out + ([separator.join(held)] if held else [])


def test_fixed_packing(spark, data):
    got = sorted(map(tuple, QUERIES["b1_fixed_packed"](spark, data).collect()))
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    assert got == sorted((d["doc_id"], i, c) for d in docs for i, c in enumerate(plain_pack(d["text"], 500, 50, "\n")))


def test_chunks_of_whole_documents(spark, data):
    """Recursive and code chunks in order hold all letters and digits of their document; only separators may be left out between them."""
    bare = lambda t: "".join(c for c in t if c.isalnum())
    docs = {d["doc_id"]: d["text"] for d in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for name in ("b4_recursive", "b6_code"):
        got = {}
        for r in QUERIES[name](spark, data).orderBy("doc_id", "chunk_index").collect():
            assert r["chunk_index"] == len(got.setdefault(r["doc_id"], []))
            got[r["doc_id"]].append(r["chunk"])
        assert set(got) == {i for i, t in docs.items() if t and t.strip()}
        for i, chunks in got.items():
            at, text = 0, bare(docs[i])
            for own in map(bare, chunks):
                found = text.rfind(own, 0, at + len(own))  # as late as it may start
                assert 0 <= found <= at, (name, i)
                at = max(at, found + len(own))
            assert at == len(text) and max(map(len, chunks)) <= 2 * 500 + 2, (name, i)  # a piece that is repeated for the overlap goes in front


def test_rebuild_is_the_chunks_of_active_documents(spark, data):
    from larkspine.plans.queries_index import registry_rows

    live = {r[0] for r in registry_rows(Tables(spark, data)).where("status <> 'DELETED'").select("document_id").collect()}
    got = QUERIES["i10_rebuild"](spark, data).collect()
    whole = {(r["doc_id"], r["chunk_index"], r["chunk"]) for r in QUERIES["b4_recursive"](spark, data).collect()}
    assert {tuple(r[c] for c in ("doc_id", "chunk_index", "chunk")) for r in got} == {w for w in whole if any(x.endswith(f"/{w[0]}") or x.endswith(str(w[0])) and not x[: -len(str(w[0]))][-1:].isdigit() for x in live)}
