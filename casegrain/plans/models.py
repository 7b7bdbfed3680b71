"""Models as Spark ML jobs: outcome classifier, soft-label distillation,
token-level rationale tagger, k-fold evaluation, batch prediction.

The reference fine-tunes transformers; here the same data flow (split
before fitting, per-"epoch" validation metrics, keep-the-best with a
save-last fallback, class-weighted token loss, soft teacher labels) is
expressed with distributed linear models.  Candidates ("epochs") are a
short driver loop of ``Pipeline.fit`` calls; every fit, transform and
metric runs on the cluster, and only one-row metric results come back.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casegrain.functions.text import TOKEN_PATTERN, WINDOW_TOKENS, hex8, let, tokens, trim_ws
from casegrain.operators import metrics as M
from casegrain.operators.annotations import class_weights
from casegrain.operators.render import decode_outcome, render_highlight
from casegrain.operators.sampling import train_val_split
from casegrain.plans import token_logistic as TL
from casegrain.session import materialize, spread

# ---- fixed values (model parameters) ----------------------------------------
EPOCH_ITERATIONS = (5, 10, 20)      # candidate "epochs" = optimiser iterations
CLASSIFIER_FEATURES = 1 << 12
TEACHER_FEATURES = 1 << 14
STUDENT_FEATURES = 1 << 10
TAGGER_FEATURES = 1 << 14
N_FOLDS = 5
# -----------------------------------------------------------------------------


def outcome_pipeline(max_iter: int, num_features: int = CLASSIFIER_FEATURES, text: str = "text",
                     label: str = "label", weight: str | None = None) -> Pipeline:
    lr = LogisticRegression(featuresCol="features", labelCol=label, maxIter=max_iter, regParam=0.01)
    if weight:
        lr.setWeightCol(weight)
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="words", pattern=TOKEN_PATTERN, gaps=False, toLowercase=True),
        HashingTF(inputCol="words", outputCol="tf", numFeatures=num_features),
        IDF(inputCol="tf", outputCol="features"),
        lr,
    ])


def _scored(model, df: DataFrame, label: str = "label") -> DataFrame:
    out = model.transform(df)
    return out.select("*", F.col("prediction").cast("int").alias("pred"),
                      vector_to_array("probability")[1].alias("p_allowed"))


def _counted(texts: DataFrame, hashers: dict[str, Pipeline], keep, name: str) -> DataFrame:
    """``keep`` and, per name, the hashed token counts of an outcome pipeline: texts are cut into tokens once for all fits and scores that follow."""
    first = next(iter(hashers.values())).getStages()[0]
    out = first.transform(texts)
    for col, pipeline in hashers.items():
        out = pipeline.getStages()[1].copy().setOutputCol(col).transform(out)
    return materialize(out.select(*keep, *hashers), name)


def _fitted(pipeline: Pipeline, counts: DataFrame) -> PipelineModel:
    """What ``pipeline.fit`` gives, from the counts ``tf`` of its training texts."""
    tokenizer, hasher, idf, layer = pipeline.getStages()
    idf = idf.fit(counts)
    return PipelineModel([tokenizer, hasher, idf, layer.fit(idf.transform(counts))])


def _from_counts(model: PipelineModel) -> PipelineModel:
    """The stages of an outcome model after the token counts ``tf``."""
    return PipelineModel(model.stages[2:])


def train_classifier(corpus: DataFrame, save_to: str | None = None, start: PipelineModel | None = None):
    """Fit one candidate per "epoch" on train, score dev, keep the best by F1
    (strictly above 0, first wins; else the last), report it on test.

    With ``start`` (the saved distilled model) its fitted feature stages are
    kept and only the outcome layer is trained. All candidates share the feature stages, so texts are cut and hashed once.
    Returns (metrics DataFrame, best PipelineModel, best epoch).
    """
    texts = corpus.filter(F.col("split").isin("train", "dev", "test")).select("split", "doc_id", "text", "label")
    if start is None:
        pipeline = outcome_pipeline(EPOCH_ITERATIONS[0])
        splits = _counted(texts, {"tf": pipeline}, ("split", "doc_id", "label"), "outcome-splits")
        tokenizer, hasher, idf, _ = pipeline.getStages()
        before = [tokenizer, hasher, idf.fit(splits.filter("split = 'train'"))]
    else:
        before = start.stages[:-1]
        splits = materialize(PipelineModel(before[:2]).transform(texts).select("split", "doc_id", "label", "tf"), "outcome-splits")
    splits = before[-1].transform(splits)
    train, dev, test = (splits.filter(F.col("split") == x).drop("split") for x in ("train", "dev", "test"))
    layers, rows = {}, None
    for epoch, iters in enumerate(EPOCH_ITERATIONS, 1):
        layers[epoch] = outcome_pipeline(iters).getStages()[-1].fit(train)
        met = M.binary_metrics(_scored(layers[epoch], dev).select(F.lit("classifier").alias("run"),
                                                                  F.lit(epoch).cast("bigint").alias("epoch"), "pred", "label"))
        rows = met if rows is None else rows.unionByName(met)
    dev_metrics = materialize(rows.withColumn("split", F.lit("dev")), "classifier-metrics")
    best_epoch = int(M.best_epoch(dev_metrics).first()["best_epoch"])
    model = PipelineModel([*before, layers[best_epoch]])
    if save_to:
        model.write().overwrite().save(save_to)
    test_metrics = M.binary_metrics(_scored(layers[best_epoch], test).select(
        F.lit("classifier").alias("run"), F.lit(best_epoch).cast("bigint").alias("epoch"), "pred", "label")
    ).withColumn("split", F.lit("test"))
    return dev_metrics.unionByName(test_metrics).withColumn("selected", F.col("epoch") == best_epoch), model, best_epoch


def train_distilled(corpus: DataFrame, save_to: str | None = None):
    """Teacher (wide hashed features) → student (narrow) trained on the teacher's
    soft labels: each row twice, label 1 with weight p and label 0 with 1 − p.
    Reports agreement, KL(teacher ‖ student) and both F1 on dev."""
    wide = outcome_pipeline(20, TEACHER_FEATURES)
    narrow = outcome_pipeline(20, STUDENT_FEATURES, label="soft_label", weight="w")
    splits = _counted(corpus.filter(F.col("split").isin("train", "dev")).select("split", "doc_id", "text", "label"),
                      {"tf_wide": wide, "tf_narrow": narrow}, ("split", "doc_id", "label"), "distill-splits")
    train, dev = (splits.filter(F.col("split") == x).drop("split") for x in ("train", "dev"))
    as_wide = lambda df: df.select("*", F.col("tf_wide").alias("tf"))
    teacher = _fitted(wide, as_wide(train))
    soft = materialize(_scored(_from_counts(teacher), as_wide(train)).select(F.col("tf_narrow").alias("tf"), "p_allowed"), "soft-labels")
    doubled = soft.select("tf", F.explode(F.array(
        F.struct(F.lit(1.0).alias("soft_label"), F.col("p_allowed").alias("w")),
        F.struct(F.lit(0.0).alias("soft_label"), (1 - F.col("p_allowed")).alias("w")))).alias("r")
    ).select("tf", "r.soft_label", "r.w")
    student = _fitted(narrow, doubled)
    if save_to:
        student.write().overwrite().save(save_to)
    t = _scored(_from_counts(teacher), as_wide(dev)).select("doc_id", "label", F.col("pred").alias("t_pred"), F.col("p_allowed").alias("pt"))
    s = _scored(_from_counts(student), dev.select("doc_id", F.col("tf_narrow").alias("tf"))).select(
        "doc_id", F.col("pred").alias("s_pred"), F.col("p_allowed").alias("ps"))
    j = materialize(t.join(s, "doc_id"), "distill-scores")
    eps = 1e-12
    kl = (F.col("pt") * F.log((F.col("pt") + eps) / (F.col("ps") + eps))
          + (1 - F.col("pt")) * F.log((1 - F.col("pt") + eps) / (1 - F.col("ps") + eps)))
    summary = j.agg(F.count(F.lit(1)).cast("bigint").alias("n_dev"),
                    F.round(F.avg((F.col("t_pred") == F.col("s_pred")).cast("double")), 6).alias("agreement"),
                    F.round(F.avg(kl), 6).alias("kl_teacher_student"))
    f1 = M.binary_metrics(j.select(F.lit("teacher").alias("run"), F.lit(1).cast("bigint").alias("epoch"),
                                   F.col("t_pred").alias("pred"), "label")).unionByName(
        M.binary_metrics(j.select(F.lit("student").alias("run"), F.lit(1).cast("bigint").alias("epoch"),
                                  F.col("s_pred").alias("pred"), "label")))
    return summary, f1, teacher, student


def token_rows(docs: DataFrame, labels: str | None = None, id_col: str = "doc_id", text: str = "text",
               keep=()) -> DataFrame:
    """One row per token of the whole text with context features (token, neighbours,
    place in its model window, length) and, when given, its 0/1 label from the
    array ``labels`` beside the tokens.  Neighbours come from the same array: no shuffle.
    """
    toks = tokens(F.coalesce(F.col(text), F.lit("")))
    rows = let(toks, lambda t: F.transform(t, lambda x, i: F.struct(
        x.alias("token"), F.coalesce(F.get(t, i - 1), F.lit("<s>")).alias("before"),
        F.coalesce(F.get(t, i + 1), F.lit("</s>")).alias("after"))))
    source = docs.select(id_col, *keep, rows.alias("rows"), *([F.col(labels).alias("labels")] if labels else []))
    if labels:
        zipped = F.zip_with("rows", "labels", lambda r, y: F.struct(r.alias("r"), y.alias("y")))
    else:
        zipped = F.transform("rows", lambda r: F.struct(r.alias("r")))
    ex = source.select(id_col, *keep, F.posexplode_outer(zipped).alias("pos", "z")).filter(F.col("z.r").isNotNull())
    token = F.col("z.r.token")
    feats = F.array(
        F.concat(F.lit("t="), token), F.concat(F.lit("p="), F.col("z.r.before")), F.concat(F.lit("n="), F.col("z.r.after")),
        F.concat(F.lit("d="), F.floor((F.col("pos") % WINDOW_TOKENS) * 10 / WINDOW_TOKENS).cast("string")),
        F.concat(F.lit("l="), F.least(F.length(token), F.lit(12)).cast("string")))
    return ex.select(id_col, *keep, "pos", token.alias("token"), feats.alias("feats"),
                     *([F.col("z.y").cast("double").alias("label")] if labels else []))


def whole_labels(masks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Window masks → one 0/1 array per document beside its tokens (start and end ids left out)."""
    part = F.struct("window_no", F.slice("rationale_mask", 2, F.col("n_active").cast("int") - 2).alias("m"))
    return masks.groupBy(id_col).agg(F.flatten(F.transform(
        F.array_sort(F.collect_list(part)), lambda x: x["m"])).alias("labels"))


def tagger_stages(max_iter: int) -> tuple[HashingTF, LogisticRegression]:
    return (HashingTF(inputCol="feats", outputCol="features", numFeatures=TAGGER_FEATURES, binary=True),
            LogisticRegression(featuresCol="features", labelCol="label", weightCol="w", maxIter=max_iter, regParam=0.001))


def train_rationale(masks: DataFrame, texts: DataFrame, id_col: str = "doc_id"):
    """Token 0/1 tagger on all expert documents and all their tokens, split by
    document, class-weighted by the training part's class weights; one candidate
    per "epoch", best by token F1 on validation (save-last fallback).

    Tokens are hashed once, into packed rows. The candidates differ in the optimiser's iterations only, so they are
    states of one path, and one pass over the validation part counts for all of them."""
    masks = materialize(masks, "masks")
    parts = train_val_split(masks.select(id_col).distinct())
    cw = class_weights(masks.join(parts.filter(F.col("part") == "train"), id_col, "left_semi")).first()
    w_neg, w_pos = float(cw["weight_negative"]), float(cw["weight_positive"])
    docs = texts.join(whole_labels(masks, id_col), id_col).join(parts, id_col)
    rows = materialize(TL.packed_rows(docs, (w_neg, w_pos), TAGGER_FEATURES), "tagger-rows")
    hasher, layer = tagger_stages(max(EPOCH_ITERATIONS))
    fitted = TL.fit_path(rows.filter(F.col("part") == "train"), EPOCH_ITERATIONS, TAGGER_FEATURES, layer.getRegParam(), layer.getTol())
    seen = TL.confusion(rows, fitted, "validation").withColumn("run", F.lit("rationale"))
    met = materialize(M.binary_metrics(seen, count="rows"), "tagger-metrics")
    best_epoch = int(M.best_epoch(met).first()["best_epoch"])
    best = TL.as_model(tagger_stages(EPOCH_ITERATIONS[best_epoch - 1])[1], *fitted[best_epoch - 1])
    return met.withColumn("selected", F.col("epoch") == best_epoch), PipelineModel([hasher, best]), (w_neg, w_pos)


def folds(labelled: DataFrame, id_col: str = "doc_id", k: int = N_FOLDS) -> DataFrame:
    """Adds ``fold``: the md5 bucket of the id mod k."""
    return labelled.withColumn("fold", (hex8(F.concat(F.lit("fold:"), F.col(id_col).cast("string"))) % k).cast("bigint"))


def kfold_metrics(labelled: DataFrame, id_col: str = "doc_id", k: int = N_FOLDS, max_iter: int = 10) -> DataFrame:
    """fold = md5 bucket of the id mod k; fit on the other folds; per-fold
    metrics plus mean and sample standard deviation rows."""
    data = materialize(folds(labelled, id_col, k), "folds")
    per = None
    for f in range(k):
        m = outcome_pipeline(max_iter).fit(data.filter(F.col("fold") != f))
        e = M.binary_metrics(_scored(m, data.filter(F.col("fold") == f)).select(
            F.lit("kfold").alias("run"), F.lit(f).cast("bigint").alias("epoch"), "pred", "label"))
        per = e if per is None else per.unionByName(e)
    per = materialize(per.withColumnRenamed("epoch", "fold").select(
        "fold", "n", "accuracy", "precision", "recall", "f1"), "fold-metrics")
    stats = per.agg(*[F.round(F.avg(c), 6).alias(f"mean_{c}") for c in ("accuracy", "f1")],
                    *[F.round(F.stddev_samp(c), 6).alias(f"std_{c}") for c in ("accuracy", "f1")])
    return per, stats


def predict_cases(cases: DataFrame, classifier: PipelineModel, tagger: PipelineModel | None,
                  keys=("case_id",), text: str = "text") -> DataFrame:
    """A row per case: outcome and rendered rationale over the whole text.

    Blank or null texts keep their row with null results and ``blank`` true.
    Rows are told apart by their place, so null or repeated keys stay as they are.

    Rationale: the token tagger when present; otherwise the classifier's own
    evidence: tokens whose feature weight magnitude is above the text's mean
    (strict), looked up through the classifier's fitted hasher.
    """
    if classifier is None:
        raise ValueError("no classifier: nothing can be scored")
    keys = list(keys)
    body = F.coalesce(F.col(text), F.lit(""))
    # A micro-batch may be one file; its texts are worth all cores.
    rows = spread(materialize(cases.select(
        F.monotonically_increasing_id().alias("_row"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        body.alias("text"), (F.length(trim_ws(body)) == 0).alias("blank")), "cases"))
    rows = rows.withColumn("_tokens", F.when(~F.col("blank"), tokens("text")))
    if tagger is not None:
        layer = tagger.stages[-1]
        rows = TL.with_marks(rows, "_tokens", (layer.coefficients.toArray(), layer.intercept), "mask")
    else:
        masks = _evidence(rows.filter(~F.col("blank")), classifier).groupBy("_row").agg(F.transform(
            F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("mask"))
        rows = rows.join(masks, "_row", "left")
    live = lambda value: F.when(~F.col("blank"), value)
    shown = render_highlight("_tokens", F.concat(F.array(F.lit(0)), F.coalesce("mask", F.array().cast("array<int>"))))
    return _scored(classifier, rows).select(
        *[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "blank", live(F.round("p_allowed", 6)).alias("p_allowed"),
        live(decode_outcome(F.col("pred"))).alias("outcome"), live(shown).alias("rationale_text"))


def _evidence(live: DataFrame, classifier: PipelineModel) -> DataFrame:
    """(_row, pos, m): 1 where a token's weight magnitude is above the mean of its text."""
    hasher, layer = classifier.stages[1], classifier.stages[-1]
    toks = live.select("_row", F.posexplode("_tokens").alias("pos", "token"))
    types = materialize(toks.select("token").distinct(), "case-types")
    # One token per "document": the only index of its vector is the token's bucket.
    one = types.withColumn("_one", F.array("token"))
    bucket = HashingTF(inputCol="_one", outputCol="_v", numFeatures=hasher.getNumFeatures()).transform(one).select(
        "token", F.array_position(vector_to_array("_v"), F.lit(1.0)).cast("int").alias("b"))
    weights = F.array(*[F.lit(float(abs(c))) for c in layer.coefficients.toArray()])   # as many as the hasher's buckets
    known = bucket.select("token", F.element_at(weights, F.col("b")).alias("w"))
    each = toks.join(known, "token").select("_row", "pos", "w")
    mean = each.groupBy("_row").agg(F.avg("w").alias("mean"))
    return each.join(mean, "_row").select("_row", "pos", (F.col("w") > F.col("mean")).cast("int").alias("m"))
