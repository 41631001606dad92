from collections import defaultdict

import duckdb
import public_tokenizers
import pytest
import tiktoken
from brute import components, exact, line_dedup, quality, sha
from cases import awkward, frame, split_words
from test_mixing import raked
from test_near_texts import groups

import corpus_pipeline
from lakepulse.llm import mixing, quality_rules
from lakepulse.llm.byte_bpe import VOCABULARY, Vocabulary
from lakepulse.llm.exact_dedup import OP9_SQL
from lakepulse.llm.line_dedup import OP1_SQL
from lakepulse.llm.queries import QUERIES
from lakepulse.llm.text import documents
from lakepulse.session import ARROW_BYTES


@pytest.fixture(scope="module")
def docs(tiny):
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{tiny}/documents.parquet' ORDER BY doc_id").fetchall()


def test_pipeline_equals_brute_force(spark, tiny, docs):
    of = {d: (lang, source) for d, _, lang, source in docs}
    now = [(d, t) for d, t, *_ in docs if quality(t, quality_rules.MAX_COVERED, quality_rules.MAX_LINE_COPIES)[-1]]
    now = [(d, t) for d, _, _, t in line_dedup(now)]
    stay = {d for d, least in groups(now) if d == least}
    now = [(d, t) for d, t in now if d in stay]
    table = spark.createDataFrame([(d, t, *of[d]) for d, t in now], "doc_id long, text string, lang string, source string")
    marked = {r["doc_id"]: r for r in mixing.mix(table).collect()}
    cells = defaultdict(int)
    for d, t in now:
        cells[of[d][1], of[d][0], marked[d]["topic"]] += len(split_words(t))
    shares = [defaultdict(float) for _ in range(3)]
    for c, n in cells.items():
        for k in range(3):
            shares[k][c[k]] += n
    rates = raked(cells, [{k: v**mixing.POWER for k, v in s.items()} for s in shares], mixing.BUDGET, mixing.MAX_RATE)
    for d, _ in now:
        assert marked[d]["rate"] == pytest.approx(rates[of[d][1], of[d][0], marked[d]["topic"]], rel=1e-6)
    now = [(d, t) for d, t in now if marked[d]["copies"]]
    with open(public_tokenizers.path(VOCABULARY), "rb") as file:
        ranks = Vocabulary(file.read()).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = sorted((d, *reversed(of[d]), library.encode_ordinary(t), sha(t)) for d, t in now)
    got = corpus_pipeline.run(spark, tiny).collect()
    assert sorted((r["doc_id"], r["source"], r["lang"], r["ids"], r["decoded_sha256"]) for r in got) == expected
    assert 0 < len(expected) < len(docs)


def test_stages_return_the_columns_of_documents(spark, tiny):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near-duplicates", "mixture", "tokens"]
    rows = frame(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, rows, tiny)
        assert got.schema.names == rows.schema.names and [f.dataType for f in got.schema] == [f.dataType for f in rows.schema], name
        assert stage(spark, frame(spark, []), tiny).count() == 0
    assert corpus_pipeline.tokens(spark, rows, tiny).count() == len(awkward())


def test_line_stage_counts_characters_anew(spark, tiny):
    got = corpus_pipeline.lines(spark, frame(spark), tiny).where("doc_id BETWEEN 20 AND 26").collect()
    assert got and all(r["n_chars"] == len(r["text"]) for r in got)


@pytest.mark.parametrize("name, sql", [("op1_line_dedup", OP1_SQL), ("op9_exact_dedup", OP9_SQL)])
def test_sql(spark, tiny, name, sql):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tiny}/documents.parquet'")
    found = duckdb.sql(sql)
    got = QUERIES[name](spark, tiny).select(*found.columns)
    assert sorted(found.fetchall()) == sorted(tuple(r) for r in got.collect())


def test_queries_equal_brute_force(spark, tiny, docs):
    pairs = [(d, t) for d, t, *_ in docs]
    got = {r["doc_id"]: r for r in QUERIES["op10_simhash"](spark, tiny).collect()}
    for d, fp, least in components(pairs):
        assert (got[d]["fingerprint"], got[d]["component_id"]) == (f"{fp:016x}", least)
    kept = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in QUERIES["op4_quality_rules"](spark, tiny).collect()}
    assert kept == {d: quality(t, quality_rules.MAX_COVERED, quality_rules.MAX_LINE_COPIES)[-2:] for d, t in pairs}
    assert len(exact(pairs)) == QUERIES["op9_exact_dedup"](spark, tiny).count()


def test_stages_hand_small_batches_to_python(spark, tiny):
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(limit, None)
    try:
        for name in ("quality rules", "line dedup", "near-duplicates", "tokens"):
            spark.conf.unset(limit)
            corpus_pipeline.stage_of(name)(spark, documents(spark, tiny).limit(5), tiny)
            assert spark.conf.get(limit) == str(ARROW_BYTES)
        spark.conf.set(limit, "1m")
        corpus_pipeline.stage_of("tokens")(spark, documents(spark, tiny).limit(5), tiny)
        assert spark.conf.get(limit) == "1m"
    finally:
        spark.conf.unset(limit) if own is None else spark.conf.set(limit, own)
