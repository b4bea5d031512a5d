"""The registered queries on the smallest tables, held against the contract by other means."""

import hashlib
import os
import zlib

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from runscope.llm import queries
from runscope.llm.queries import vocabulary
from tests.llm import test_licenses
from tests.llm.test_simhash import plain_components, plain_fingerprint

SF = os.environ.get("QUERY_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def test_scores_tell_which_rows_were_held_out(spark):
    ids = [r["doc_id"] for r in table("documents")]
    labels = {r["doc_id"]: r["quality"] for r in table("labels")}
    got = {r["doc_id"]: r for r in queries.op2_quality(spark, SF).collect()}
    assert sorted(got) == sorted(ids)
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
    held = [i for i in labels if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == labels[i] for i in held) >= 0.9 * len(held)


def test_languages_tell_which_rows_were_held_out(spark):
    docs = table("documents")
    got = {r["doc_id"]: r for r in queries.op8_language(spark, SF).collect()}
    assert sorted(got) == sorted(r["doc_id"] for r in docs)
    right = 0
    for r in docs:
        g = got[r["doc_id"]]
        assert g["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= g["score"] <= 1
        assert (g["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or ""))
        right += g["lang_pred"] == r["lang"]
    assert right >= 0.95 * len(docs)


def test_neighbours(spark):
    rows = [(r["vec_id"], np.array(r["embedding"], float)) for r in table("embeddings") if r["embedding"] is not None and None not in r["embedding"]]
    rows = [(i, v) for i, v in rows if np.isfinite(v).all() and v.any()]
    ids, x = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    near = {}
    for r in sorted(queries.op3_neighbours(spark, SF).collect(), key=lambda r: (r["query_id"], r["rank"])):
        near.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    asked = [k for k, i in enumerate(ids) if i % 20 == 0]
    assert sorted(near) == sorted(int(ids[k]) for k in asked)
    hits = total = 0
    for k in asked:
        scores = x @ x[k]
        order = [int(ids[j]) for j in np.lexsort((ids, -scores)) if j != k][:20]
        found = near[int(ids[k])]
        assert [f[0] for f in found] == list(range(1, len(order) + 1)) and all(np.isclose(f[2], scores[np.flatnonzero(ids == f[1])[0]]) for f in found)
        hits, total = hits + len(set(order) & {f[1] for f in found}), total + len(order)
    assert hits >= 0.95 * total


def test_token_files_and_pieces_equal_the_libraries(spark):
    import sentencepiece
    from tokenizers import Tokenizer

    docs = sorted(table("documents"), key=lambda r: r["doc_id"])
    whole, start, want = Tokenizer.from_file(vocabulary("word_bpe_49k.json")), 0, []
    for r in docs:
        ids = [*whole.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want.append((r["doc_id"], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32")) for r in queries.op4_token_files(spark, SF).collect()) == want
    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(r["doc_id"], len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids))) for r in docs for ids in [sp.encode(r["text"] or "")]]
    assert sorted(tuple(r[c] for c in ("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")) for r in queries.op6_sentencepiece(spark, SF).collect()) == want


def test_fingerprints_and_base_labels(spark):
    docs = {r["doc_id"]: r["text"] for r in table("documents")}
    prints = {i: plain_fingerprint(t) for i, t in docs.items()}
    roots = plain_components(set(prints.values()))
    least = {}
    for i, f in prints.items():
        least[roots[f]] = min(i, least.get(roots[f], i))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op9_simhash(spark, SF).collect()}
    assert got == {i: (f"{f:016x}", least[roots[f]]) for i, f in prints.items()}
    found = {r["doc_id"]: r for r in queries.op10_licenses(spark, SF).collect()}
    assert set(found) == set(docs)
    for i, t in docs.items():
        r = found[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == test_licenses.base_of(t)
        assert set(r["base_labels"].split(",")) <= {*r["labels"].split(","), ""} and 0 <= r["score"] <= 1


def test_surrogates_and_leaks_cover_all_documents(spark):
    docs = {r["doc_id"]: r["text"] for r in table("documents")}
    got = {r["doc_id"]: r for r in queries.op5_surrogates(spark, SF).collect()}
    assert set(got) == set(docs)
    for i, r in got.items():
        assert (r["n_entities"] == 0) == (r["text"] == docs[i])
    assert {r["doc_id"] for r in queries.op1_leaks(spark, SF).collect()} <= set(docs)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    twin = con.execute(queries.oracle_sql()[name])
    names = sorted(c[0] for c in twin.description)
    want = sorted((tuple(dict(zip((c[0] for c in twin.description), r, strict=True))[n] for n in names) for r in twin.fetchall()), key=str)
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == names and want
    assert sorted((tuple(r[n] for n in names) for r in got.collect()), key=str) == want
