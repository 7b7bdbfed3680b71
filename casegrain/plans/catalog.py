"""Registered queries: each key builds its DataFrame from the driver's tables.

Every function takes ``(spark, sf_dir)`` and returns a lazy DataFrame whose
columns match the oracle SQL of the same key.  The library functions do
the work; this module only wires them to the stand-in tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casegrain.operators import annotations as A
from casegrain.operators import intervals as IV
from casegrain.operators import sampling as S
from casegrain.operators import tokens as TK
from casegrain.plans import standins as SI
from casegrain.session import materialize, table
from casegrain.functions.text import let, window_slice
from casegrain.functions.text import tokens as tokens_of
from casegrain.operators import losses as L
from casegrain.operators import metrics as M
from casegrain.operators.render import render_highlight
from casegrain.plans import standins_vectors as SV
from casegrain.operators import cleaning as CL
from casegrain.operators import legal as LG
from casegrain.operators import summarize as SU
from casegrain.operators import evaluation as EV
from casegrain.operators import similarity as SIM
from casegrain.operators import vectors as VE
from casegrain.plans import epochs as EP
from casegrain.plans import models as MD
from casegrain.plans import span_tagger as ST
from casegrain.sources import csv_io, token_store
from casegrain.sources.model_store import load_first, save_model
from casegrain.streaming import predict_stream as PS
from casegrain.session import scratch_path
from pyspark.sql import types as T


def _docs(spark, d):
    return table(spark, d, "documents")


def _labels(spark, d):
    return table(spark, d, "labels")


def _experts(spark, d):
    return SI.expert_split(_docs(spark, d), table(spark, d, "benchmark"))


def _corpus(spark, d):
    return SI.corpus_splits(_docs(spark, d), _labels(spark, d), _experts(spark, d))


def _masks(spark, d):
    return A.rationale_masks(_experts(spark, d))


def _train_docs(spark, d):
    c = _corpus(spark, d)
    return c.filter(F.col("split") == "train").select("doc_id", "text")


def _vocab(spark, d):
    # A model artifact: written once, its size known to the joins that read it.
    return materialize(TK.build_vocab(_train_docs(spark, d)), "vocabulary")


def _entries(spark, d):
    return materialize(TK.with_alphabet(_vocab(spark, d), _train_docs(spark, d)), "entries")


def _encoded(spark, d):
    return TK.encode_window(_docs(spark, d), _entries(spark, d))


# ---- sources --------------------------------------------------------------

def q_corpus_union(spark, d):
    c = _corpus(spark, d)
    n_exp = sum((F.when(F.col(f"expert_{k}").isNotNull(), 1).otherwise(0) for k in range(1, 6)), F.lit(0))
    return c.select("split", "doc_id", "label",
                    F.length("raw_text").cast("bigint").alias("raw_len"),
                    F.size("rationale_mask").cast("bigint").alias("mask_len"),
                    n_exp.cast("bigint").alias("n_experts")) \
        .withColumn("mask_len", F.when(F.col("split") == "test", None).otherwise(F.col("mask_len")))


# ---- tokens ---------------------------------------------------------------

def q_sentence_split(spark, d):
    return TK.sentence_rows(_docs(spark, d))


def q_word_tokens(spark, d):
    t = _docs(spark, d).select("doc_id", tokens_of(F.coalesce(F.col("text"), F.lit(""))).alias("toks"))
    return t.select(
        "doc_id",
        F.size("toks").cast("bigint").alias("n_tokens"),
        F.size(F.array_distinct("toks")).cast("bigint").alias("n_types"),
        F.aggregate("toks", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("token_chars"),
        F.md5(F.array_join("toks", " ")).alias("tokens_md5"),
    )


def q_token_offsets(spark, d):
    return TK.token_offsets(_docs(spark, d))


def q_vocab_encode(spark, d):
    return _vocab(spark, d)


def q_pad_truncate(spark, d):
    e = _encoded(spark, d).filter("window_no = 0")      # truncation is the feature here
    return e.select("doc_id", "n_tokens",
                    F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_attention"),
                    F.array_join("input_ids", " ").alias("ids_text"))


# ---- annotations → masks ----------------------------------------------------

def q_annotation_parse(spark, d):
    return A.annotation_rows(_experts(spark, d))


def q_rationale_sentences(spark, d):
    r = A.with_rationale_sentences(_experts(spark, d))
    return r.select("doc_id", F.explode_outer("rationale_sentences").alias("sentence")).filter(F.col("sentence").isNotNull())


def q_sentence_match(spark, d):
    m = A.with_matched_sentences(A.with_rationale_sentences(_experts(spark, d)))
    return m.select("doc_id", F.explode_outer("matched_sentences").alias("sentence")).filter(F.col("sentence").isNotNull())


def _spans(spark, d):
    m = A.with_matched_sentences(A.with_rationale_sentences(_experts(spark, d)))
    return A.with_spans(m)


def q_span_occurrences(spark, d):
    s = _spans(spark, d).select("doc_id", F.explode_outer("spans").alias("sp")).filter(F.col("sp").isNotNull())
    return s.select("doc_id", "sp.sentence", F.col("sp.start").cast("bigint").alias("start"),
                    F.col("sp.end").cast("bigint").alias("end"))


def q_token_span_overlap(spark, d):
    p = A.with_span_positions(_spans(spark, d)).select("doc_id", F.explode_outer("span_positions").alias("x")) \
        .filter(F.col("x").isNotNull())
    return p.select("doc_id", *[F.col(f"x.{c}").cast("bigint").alias(c) for c in ("start", "end", "lo", "hi")])


def q_rationale_mask(spark, d):
    m = _masks(spark, d)
    return m.select("doc_id", "window_no", "n_active", "n_positive",
                    F.array_join(F.transform("rationale_mask", lambda x: x.cast("string")), "").alias("mask_bits"))


def q_interval_mask(spark, d):
    """The masks again, from annotations in a table of their own."""
    experts = _experts(spark, d)
    m = IV.interval_masks(experts.select("doc_id", "text"), A.annotation_rows(experts))
    return m.select("doc_id", "window_no", "n_active", "n_positive",
                    F.array_join(F.transform("rationale_mask", lambda x: x.cast("string")), "").alias("mask_bits"))


def q_rationale_coverage(spark, d):
    return A.coverage(_masks(spark, d))


def q_train_val_split(spark, d):
    return S.train_val_split(_docs(spark, d).select("doc_id")).select("doc_id", "part")


def q_class_weights(spark, d):
    m = _masks(spark, d)
    parts = S.train_val_split(_docs(spark, d).select("doc_id"))
    return A.class_weights(m.join(parts.filter(F.col("part") == "train"), "doc_id", "left_semi"))


# ---- sampling ---------------------------------------------------------------

def q_mlm_mask(spark, d):
    m = S.mlm_mask(_encoded(spark, d))
    flags = F.transform(F.arrays_zip("input_ids", "masked_ids"), lambda z, i: F.struct(
        (~z["input_ids"].isin(0, 101, 102)).alias("cand"), (z["masked_ids"] != z["input_ids"]).alias("m"), i.alias("i")))
    summary = let(flags, lambda f: F.struct(
        F.size(F.filter(f, lambda x: x["cand"])).cast("bigint").alias("n_candidates"),
        F.size(F.filter(f, lambda x: x["m"])).cast("bigint").alias("n_masked"),
        F.array_join(F.transform(F.filter(f, lambda x: x["m"]), lambda x: x["i"].cast("string")), " ")
        .alias("masked_positions")))
    return m.select("doc_id", "window_no", summary.alias("s")).select("doc_id", "window_no", "s.*")


# ---- losses over the embeddings stand-in ------------------------------------

def _emb(spark, d):
    return table(spark, d, "embeddings")


def _batch_losses(spark, d):
    return L.batch_losses(SV.distill_pairs(_emb(spark, d)))


def q_kl_distill_loss(spark, d):
    b = _batch_losses(spark, d)
    return b.select("batch", F.col("n_rows").cast("bigint").alias("n_rows"), F.round("kl_loss", 6).alias("kl_loss"))


def q_cosine_hidden_loss(spark, d):
    b = _batch_losses(spark, d)
    return b.select("batch", F.col("n_rows").cast("bigint").alias("n_rows"),
                    F.round("cosine_loss", 6).alias("cosine_loss"))


def q_mlm_loss(spark, d):
    b = _batch_losses(spark, d)
    return b.select("batch", F.col("n_rows").cast("bigint").alias("n_rows"), F.round("mlm_loss", 6).alias("mlm_loss"),
                    F.round("mlm_loss_masked", 6).alias("mlm_loss_masked"))


def q_combined_loss(spark, d):
    b = _batch_losses(spark, d)
    return b.select("batch", F.col("n_rows").cast("bigint").alias("n_rows"),
                    *[F.round(c, 6).alias(c) for c in ("kl_loss", "mlm_loss", "cosine_loss", "combined_loss")])


def q_batch_mean_loss(spark, d):
    m = M.batch_mean(_batch_losses(spark, d), "combined_loss")
    return m.select("n_batches", F.round("mean_of_batch_means", 6).alias("mean_of_batch_means"),
                    F.round("row_weighted_mean", 6).alias("row_weighted_mean"))


def q_weighted_ce(spark, d):
    rows = SV.token_logits(_emb(spark, d))
    act = rows.filter("active")
    # One-row class-weight aggregate → two scalars.
    w = act.agg(F.count(F.lit(1)).alias("n"), F.sum("gold").alias("p")).first()
    n, p = int(w["n"] or 0), int(w["p"] or 0)
    weights = (1.0, 1.0) if p == 0 or p == n else (n / (2.0 * (n - p)), n / (2.0 * p))
    r = L.weighted_ce(rows, weights=weights)
    return r.select("batch", "n_active", F.round("weighted_ce", 6).alias("weighted_ce"))


def q_attention_rationale(spark, d):
    a = M.attention_rationale(_emb(spark, d), "label", "embedding")
    return a.select(F.col("label").cast("bigint").alias("label"), "pos", F.round("avg_weight", 9).alias("avg_weight"),
                    F.col("mask").cast("bigint").alias("mask"))


# ---- metrics and selection ------------------------------------------------

# fixed values: stand-in predictions, epoch e predicts 1 when n_chars > step·e
EPOCH_RUNS = (("classifier", 3, 200), ("rationale", 10, 300))


def _epoch_pairs(spark, d):
    lab = _docs(spark, d).select("doc_id", "n_chars").join(
        _labels(spark, d).select("doc_id", F.col("quality").alias("label")), "doc_id")
    runs = F.array(*[F.struct(F.lit(r).alias("run"), F.lit(e).alias("epochs"), F.lit(s).alias("step"))
                     for r, e, s in EPOCH_RUNS])
    x = lab.select("doc_id", "n_chars", "label", F.explode(runs).alias("r"))
    x = x.select("doc_id", "n_chars", "label", "r.run", "r.step",
                 F.explode(F.sequence(F.lit(1), F.col("r.epochs"))).alias("epoch"))
    return x.select("run", F.col("epoch").cast("bigint").alias("epoch"), "label",
                    F.when(F.col("n_chars") > F.col("step") * F.col("epoch"), 1).otherwise(0).alias("pred"))


def q_epoch_metrics(spark, d):
    return M.binary_metrics(_epoch_pairs(spark, d))


def q_best_epoch(spark, d):
    return M.best_epoch(M.binary_metrics(_epoch_pairs(spark, d)))


def q_highlight_render(spark, d):
    ex = _experts(spark, d)
    m = A.rationale_masks(ex, keep=("doc_id", "text"))
    toks = window_slice(tokens_of(F.coalesce(F.col("text"), F.lit(""))), "window_no")
    return m.select("doc_id", "window_no", render_highlight(toks, "rationale_mask").alias("rationale_text"))


# ---- ingestion, cleaning, sections ------------------------------------------

def q_html_to_text(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id", "url", CL.html_to_text("html").alias("text")).select(
        "page_id", "url", F.length("text").cast("bigint").alias("text_len"), "text")


def q_clean_text(spark, d):
    c = _docs(spark, d).select("doc_id", "text", CL.clean_text("text").alias("clean"))
    return c.select("doc_id",
                    F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("bigint").alias("n_lines_in"),
                    F.size(F.split("clean", "\n", -1)).cast("bigint").alias("n_lines_out"),
                    F.length("clean").cast("bigint").alias("clean_len"), F.md5("clean").alias("clean_md5"))


def _legal(spark, d):
    return _docs(spark, d).select("doc_id", "source", SI.legal_text().alias("text"))


def q_section_split(spark, d):
    return CL.split_sections(_legal(spark, d))


# ---- legal extraction -------------------------------------------------------

def q_entity_extract(spark, d):
    return LG.extract_entities(_legal(spark, d))


def q_citation_extract(spark, d):
    return LG.extract_citations(_legal(spark, d))


def _aliases(spark):
    return spark.createDataFrame(LG.CODE_ALIASES, "spelling string, code string")


def _case_keys(spark, d):
    return LG.canonical_keys(LG.extract_citations(_legal(spark, d)), _aliases(spark))


def q_citation_normalize(spark, d):
    k = _case_keys(spark, d)
    return k.groupBy("canonical_key", "kind").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_mentions"),
        F.countDistinct("doc_id").cast("bigint").alias("n_docs"))


def q_extractive_summary(spark, d):
    top = SU.top_sentences(SU.sentence_scores(_docs(spark, d)))
    return top.select("doc_id", "rank", "sent_pos", "score")


def q_summary_text(spark, d):
    return SU.summaries(SU.top_sentences(SU.sentence_scores(_docs(spark, d))))


def q_clause_classify(spark, d):
    return LG.classify_sentences(_legal(spark, d)).drop("sentence")


def q_risk_report(spark, d):
    docs = _legal(spark, d)
    return LG.risk_report(LG.risk_scores(LG.classify_sentences(docs)), docs)


def q_riskiest_clauses(spark, d):
    return LG.riskiest_clauses(LG.classify_sentences(_legal(spark, d)))


def q_precedent_score(spark, d):
    return LG.precedent_scores(_legal(spark, d), _aliases(spark))


# ---- similarity, clustering ---------------------------------------------------

def q_similarity_topk(spark, d):
    emb = _emb(spark, d)
    cen = SIM.label_centroids(emb).select(F.col("label").cast("bigint").alias("query_id"),
                                          F.col("centroid").alias("query_vec"))
    return SIM.top_k_similar(emb, cen, k=5, exclude_self=False)


def q_similarity_rows(spark, d):
    emb = _emb(spark, d)
    own = emb.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    return SIM.top_k_similar(emb, own, k=5, exclude_self=True)


def q_similarity_lsh(spark, d):
    return SIM.near_duplicates(_docs(spark, d).select("doc_id", "text"))


def q_similarity_cells(spark, d):
    emb = _emb(spark, d)
    own = emb.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    return VE.search(VE.build_index(emb), own, k=5)


def q_clustering(spark, d):
    c = SIM.kmeans_clusters(_emb(spark, d))
    return c.select("cluster", "size", "majority_label", F.round("purity", 6).alias("purity"))


# ---- summary and extractor metrics --------------------------------------------

def _summary_pairs(spark, d):
    """Candidate = the extractive summary, reference = the sentences that experts chose, in document order."""
    # Parsed once: a filter on the sentences would parse the annotations again, and so would each use of the tokens.
    chosen = materialize(A.with_matched_sentences(A.with_rationale_sentences(_experts(spark, d))).select(
        "doc_id", "matched_sentences"), "chosen-sentences")
    ref = chosen.filter(F.size("matched_sentences") > 0).select(
        "doc_id", F.array_join("matched_sentences", " ").alias("ref"))
    return materialize(q_summary_text(spark, d).join(ref, "doc_id").select(
        F.col("doc_id").cast("string").alias("pair"), tokens_of("summary").alias("cand"), tokens_of("ref").alias("ref")), "summary-pairs")


def q_rouge_n(spark, d):
    return EV.rouge_n(_summary_pairs(spark, d), "pair", "cand", "ref")


def q_bleu(spark, d):
    return EV.corpus_bleu(_summary_pairs(spark, d), "pair", "cand", "ref")


def q_rouge_l(spark, d):
    return EV.rouge_l(_summary_pairs(spark, d), "pair", "cand", "ref")


def q_extractor_prf(spark, d):
    docs = _docs(spark, d)
    pred = LG.extract_entities(docs.select("doc_id", SI.legal_text().alias("text")))
    gold = LG.extract_entities(docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("_off"),
                                           SI.legal_template().alias("tpl")), text="tpl")
    offs = docs.select("doc_id", (F.length(F.coalesce("text", F.lit(""))) + 1).alias("_off"))
    gold = gold.join(offs, "doc_id").select("doc_id", "type", (F.col("start") + F.col("_off")).alias("start"),
                                            (F.col("end") + F.col("_off")).alias("end"))
    return EV.span_prf(pred, gold)


# ---- sources: CSV round trip, token store -------------------------------------

CORPUS_CSV_SCHEMA = T.StructType([
    T.StructField("split", T.StringType()), T.StructField("doc_id", T.LongType()),
    T.StructField("label", T.IntegerType()), T.StructField("text", T.StringType()),
    T.StructField("rationale_mask", T.StringType()),
    *[T.StructField(f"expert_{k}", T.StringType()) for k in range(1, 6)],
])


def q_csv_roundtrip(spark, d):
    # Expert rows carry the computed mask of their whole text, window after window; the others the reference's zeros.
    whole = _masks(spark, d).groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(
        F.struct("window_no", "rationale_mask"))), lambda x: x["rationale_mask"])).alias("whole"))
    c = _corpus(spark, d)
    expert = c.where("split = 'expert'").join(whole, "doc_id", "left").withColumn("rationale_mask", F.col("whole")).drop("whole")
    c = c.where("split <> 'expert'").unionByName(expert).select(
        "split", "doc_id", "label", "text", "rationale_mask", *[f"expert_{k}" for k in range(1, 6)])
    path = scratch_path(spark, "csv/corpus")
    csv_io.write_csv(c, path, array_cols=("rationale_mask",))
    back = csv_io.read_csv(spark, path, CORPUS_CSV_SCHEMA, array_cols={"rationale_mask": "array<int>"})
    n_exp = sum((F.when(F.col(f"expert_{k}").isNotNull(), 1).otherwise(0) for k in range(1, 6)), F.lit(0))
    return back.select(
        "split", "doc_id", "label", F.md5("text").alias("text_md5"),
        F.when(F.col("rationale_mask").isNotNull(), F.size("rationale_mask")).cast("bigint").alias("mask_len"),
        F.aggregate("rationale_mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("mask_sum"),
        n_exp.cast("bigint").alias("n_experts"))


def q_token_store(spark, d):
    docs = A.with_rationale_sentences(_experts(spark, d))
    docs = A.with_matched_sentences(docs).select("doc_id", "text", "matched_sentences")
    enc = TK.encode_window(docs, _entries(spark, d), offsets=True, marked="matched_sentences")
    splits = SI.labelled_splits(_labels(spark, d)).unionByName(
        docs.select("doc_id", F.lit("expert").alias("split")))
    # Offsets are kept for all splits but train, masks for the expert split.
    enc = enc.join(splits, "doc_id").withColumns({
        "offset_mapping": F.when(F.col("split") != "train", F.col("offset_mapping")),
        "rationale_mask": F.when(F.col("split") == "expert", F.col("rationale_mask"))})
    path = scratch_path(spark, "tokens")
    token_store.write_tokens(enc, path)
    back = token_store.read_tokens(spark, path, columns=(
        "doc_id", "window_no", "input_ids", "attention_mask", "offset_mapping", "rationale_mask"))
    places = F.array_join(F.transform("offset_mapping", lambda x: F.concat_ws("-", x["start"], x["end"])), " ")
    return back.select("split", "doc_id", "window_no",
                       F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_attention"),
                       F.md5(F.array_join("input_ids", " ")).alias("ids_md5"), F.md5(places).alias("offsets_md5"),
                       F.md5(F.array_join("rationale_mask", "")).alias("mask_md5"))


def q_subword_segment(spark, d):
    vocab = _vocab(spark, d)
    types = (_docs(spark, d).select(F.explode_outer(tokens_of(F.coalesce(F.col("text"), F.lit("")))).alias("token"))
             .filter(F.col("token").isNotNull()).distinct())
    rare = types.join(vocab.select("token"), "token", "left_anti")
    seg = TK.segment_rare(rare, vocab)
    return seg.select("token", F.size("pieces").cast("bigint").alias("n_pieces"),
                      F.array_join("pieces", " ").alias("pieces_text"))


# ---- models (rows-checked: model quality is not SQL) --------------------------



def q_classifier_train(spark, d):
    base = scratch_path(spark, "models")
    corpus = _corpus(spark, d)
    MD.train_distilled(corpus, save_to=f"{base}/distilled")
    met, _, _ = MD.train_classifier(corpus, save_to=f"{base}/classifier",
                                    start=load_first(spark, [f"{base}/distilled"], required=True))
    return met


def q_distill_train(spark, d):
    summary, f1, _, _ = MD.train_distilled(_corpus(spark, d), save_to=scratch_path(spark, "models/distilled"))
    s = summary.first()
    return f1.select("run", "n", "accuracy", "precision", "recall", "f1",
                     F.lit(s["agreement"]).alias("agreement"), F.lit(s["kl_teacher_student"]).alias("kl_teacher_student"))


def q_distill_epochs(spark, d):
    """Losses of the student's real outputs per mini-batch of every epoch."""
    out = EP.distill(_corpus(spark, d))["losses"]
    return out.select("epoch", "batch", "n_rows", *[F.round(c, 6).alias(c) for c in (
        "kl_loss", "label_loss", "cosine_loss", "combined_loss", "running_mean")])


def q_epoch_training(spark, d):
    """Mean of the mini-batch losses while training, and the dev metrics, of every epoch of teacher and student."""
    out = EP.distill(_corpus(spark, d))
    loss = M.batch_mean(out["train"], "loss", keys=("run", "epoch"))
    return out["metrics"].join(loss, ["run", "epoch"]).select(
        "run", "epoch", "n", "accuracy", "precision", "recall", "f1", "n_batches",
        F.round("mean_of_batch_means", 6).alias("train_loss"), "selected")


def _rationale(spark, d):
    return MD.train_rationale(_masks(spark, d), _docs(spark, d).select("doc_id", "text"))


def q_span_training(spark, d):
    """Loss and held-out token metrics of the linear chain in every epoch."""
    return ST.train_spans(_experts(spark, d))[0]


def q_rationale_spans(spark, d):
    """Spans that the best chain marks in every document."""
    _, weights = ST.train_spans(_experts(spark, d), epochs=2)
    return ST.rationale_spans(_docs(spark, d), weights)


def q_rationale_train(spark, d):
    met, _, _ = _rationale(spark, d)
    return met


def _labelled(spark, d):
    return _docs(spark, d).select("doc_id", "text").join(
        _labels(spark, d).select("doc_id", F.col("quality").cast("int").alias("label")), "doc_id")


def q_kfold_assign(spark, d):
    return MD.folds(_labelled(spark, d)).select("doc_id", F.col("label").cast("bigint").alias("label"), "fold")


def q_kfold_cv(spark, d):
    labelled = _labelled(spark, d)
    per, stats = MD.kfold_metrics(labelled)
    st = stats.first()
    return per.select("*", *[F.lit(st[c]).alias(c) for c in stats.columns])


_CHAINS: dict = {}


def _trained(spark, d):
    """The chain distilled → classifier → rationale, each saved and loaded by the next, as a scoring job would.

    Trained once per application and data folder; the saved places are what is remembered.
    """
    key = (spark.sparkContext.applicationId, d)
    if key not in _CHAINS:
        _CHAINS[key] = _train_chain(spark, d)
    base = _CHAINS[key]
    return (load_first(spark, [f"{base}/classifier", f"{base}/distilled"], required=True),
            load_first(spark, [f"{base}/rationale"]))


def _train_chain(spark, d):
    base = scratch_path(spark, "models")
    corpus = materialize(_corpus(spark, d).select("split", "doc_id", "text", "label"), "corpus")
    MD.train_distilled(corpus, save_to=f"{base}/distilled")
    MD.train_classifier(corpus, save_to=f"{base}/classifier", start=load_first(spark, [f"{base}/distilled"], required=True))
    _, tagger, _ = _rationale(spark, d)
    save_model(tagger, f"{base}/rationale")
    return base


def _cases(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", "text")


def q_predict_batch(spark, d):
    clf, tagger = _trained(spark, d)
    return MD.predict_cases(_cases(spark, d), clf, tagger, keys=("conv_id", "turn"))


def q_predict_stream(spark, d):
    clf, tagger = _trained(spark, d)
    cases = _cases(spark, d)
    landing = scratch_path(spark, "stream/landing")
    PS.stage_cases(cases, landing)
    return PS.run_prediction_stream(spark, landing, cases.schema, clf, tagger, keys=("conv_id", "turn"))


def q_predict_rows(spark, d):
    """Every case once: its key, whether it is blank, whether outcome and probability agree, and the
    rationale without its brackets (the rendered text itself)."""
    clf = load_first(spark, [_fitted_classifier(spark, d)], required=True)
    out = MD.predict_cases(_cases(spark, d), clf, None, keys=("conv_id", "turn"))
    plain = F.regexp_replace("rationale_text", r"\[|\]", "")
    return out.select("conv_id", "turn", "blank",
                      F.coalesce((F.col("outcome") == "ALLOWED") == (F.col("p_allowed") > 0.5), F.col("blank")).alias("consistent"),
                      F.md5(F.regexp_replace(plain, r"[\t\n\x0B\f\r ]+", "")).alias("text_md5"))


def _fitted_classifier(spark, d):
    path = scratch_path(spark, "models/classifier")
    MD.train_classifier(_corpus(spark, d).select("split", "doc_id", "text", "label"), save_to=path)
    return path


QUERIES = {
    "corpus_union": q_corpus_union,
    "sentence_split": q_sentence_split,
    "word_tokens": q_word_tokens,
    "token_offsets": q_token_offsets,
    "vocab_encode": q_vocab_encode,
    "pad_truncate": q_pad_truncate,
    "annotation_parse": q_annotation_parse,
    "rationale_sentences": q_rationale_sentences,
    "sentence_match": q_sentence_match,
    "span_occurrences": q_span_occurrences,
    "token_span_overlap": q_token_span_overlap,
    "rationale_mask": q_rationale_mask,
    "interval_mask": q_interval_mask,
    "rationale_coverage": q_rationale_coverage,
    "train_val_split": q_train_val_split,
    "class_weights": q_class_weights,
    "mlm_mask": q_mlm_mask,
    "kl_distill_loss": q_kl_distill_loss,
    "cosine_hidden_loss": q_cosine_hidden_loss,
    "mlm_loss": q_mlm_loss,
    "combined_loss": q_combined_loss,
    "batch_mean_loss": q_batch_mean_loss,
    "weighted_ce": q_weighted_ce,
    "attention_rationale": q_attention_rationale,
    "epoch_metrics": q_epoch_metrics,
    "best_epoch": q_best_epoch,
    "highlight_render": q_highlight_render,
    "html_to_text": q_html_to_text,
    "clean_text": q_clean_text,
    "section_split": q_section_split,
    "entity_extract": q_entity_extract,
    "citation_extract": q_citation_extract,
    "citation_normalize": q_citation_normalize,
    "extractive_summary": q_extractive_summary,
    "summary_text": q_summary_text,
    "clause_classify": q_clause_classify,
    "risk_report": q_risk_report,
    "riskiest_clauses": q_riskiest_clauses,
    "precedent_score": q_precedent_score,
    "similarity_topk": q_similarity_topk,
    "similarity_rows": q_similarity_rows,
    "similarity_lsh": q_similarity_lsh,
    "similarity_cells": q_similarity_cells,
    "clustering": q_clustering,
    "rouge_n": q_rouge_n,
    "bleu": q_bleu,
    "rouge_l": q_rouge_l,
    "extractor_prf": q_extractor_prf,
    "csv_roundtrip": q_csv_roundtrip,
    "token_store": q_token_store,
    "subword_segment": q_subword_segment,
    "classifier_train": q_classifier_train,
    "distill_train": q_distill_train,
    "distill_epochs": q_distill_epochs,
    "epoch_training": q_epoch_training,
    "rationale_train": q_rationale_train,
    "span_training": q_span_training,
    "rationale_spans": q_rationale_spans,
    "kfold_assign": q_kfold_assign,
    "kfold_cv": q_kfold_cv,
    "predict_batch": q_predict_batch,
    "predict_rows": q_predict_rows,
    "predict_stream": q_predict_stream,
}
