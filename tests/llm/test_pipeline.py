import hashlib
import random
from collections import Counter

import sentencepiece

import corpus_pipeline
from tests.llm.test_parity_join import brute as groups
from tests.llm.test_quality_rules import brute as base_metrics
from veilsift.llm import quality_rules, secret_scan, source_mix, tokenizer_files


def test_stages_against_plain_versions(spark, tmp_path):
    r = random.Random(5)
    stop = "the of and to in is that for".split()
    text = lambda n: " ".join(r.choice(stop) if r.random() < 0.4 else f"word{r.randrange(400)}" for _ in range(n))
    clean = [text(r.randrange(25, 90)) for _ in range(60)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(clean)]
    rows += [(100 + i, clean[i] + (" more" if i % 2 else ""), "en", "s1", 0) for i in range(20)]
    rows += [(200, "junk ### " * 40, "en", "s0", 0), (201, "short", "en", None, 5), (202, None, None, None, None), (203, clean[1] + " password=abcdef123 " + text(40), "en", "s2", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    out, docs = [], df
    for name, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, str(tmp_path))
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        out.append(docs)
        assert name == corpus_pipeline.STAGES[-1][0] or docs.columns == df.columns
    after = [{x.doc_id: x for x in d.collect()} for d in out]

    kept = {i for i, t, *_ in rows if (m := base_metrics(t))[0] >= 20 and 100 * m[4] <= 30 * m[0]}
    assert set(after[0]) <= kept and set(range(60)) & kept <= set(after[0]) and 200 not in after[0]
    found = groups([(i, after[0][i].text) for i in after[0]], 5, 80, 100)
    assert set(after[1]) == {i for i, (_, c) in found.items() if i == c}
    assert after[2][203].text.count("<assign>") == 1 and "abcdef123" not in after[2][203].text and after[2][203].n_chars == len(after[2][203].text)
    assert all(after[2][i].text == after[1][i].text for i in after[1] if i != 203)
    copies = Counter(x.doc_id for x in out[3].collect())
    sized = out[2].withColumn("size", source_mix.size_in_words(out[2].text))
    assert {x.doc_id: x.mix.copies for x in source_mix.allocate(sized).collect() if x.mix.copies} == copies and max(copies.values()) <= 2
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizer_files.path("piece_bpe_32k.model"))
    final = out[4].collect()
    assert Counter(x.doc_id for x in final) == copies
    for x in final:
        ids = library.encode(after[3][x.doc_id].text, add_eos=True)
        assert x.n_tokens == len(ids) and x.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(tuple, final))
    assert secret_scan.RULES and quality_rules.RULES
