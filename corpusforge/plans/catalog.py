"""Registered queries: key -> (spark, sf_dir) -> DataFrame.

Each query reads the driver's tables (through the fixture views) in full and
runs the library's operators on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.config import SplitConfig
from corpusforge.operators import joins, report, scores
from corpusforge.operators.split import (group_split, merge_languages, seeded_order, split_counts,
                                         split_leakage, stratified_split)
from corpusforge.plans import evaluate, fixtures

REGISTRY: dict = {}


def query(key: str):
    def deco(fn):
        REGISTRY[key] = fn
        return fn
    return deco


def splitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified_split(fixtures.rec(spark, sf_dir), ["lang"], "doc_id", SplitConfig())


# ------------------------------------------------------------------ flagship
@query("leaderboard")
def q_leaderboard(spark, sf_dir):
    """A4: mean ROUGE-1/2/L per (run, test subtask) with the model name."""
    return evaluate.leaderboard(spark, sf_dir)


# ------------------------------------------------------------------ W / U / A11
@query("stratified_split")
def q_stratified_split(spark, sf_dir):
    return splitted(spark, sf_dir).select("doc_id", "lang", "split")


@query("seeded_order")
def q_seeded_order(spark, sf_dir):
    r = fixtures.rec(spark, sf_dir).select("doc_id", "lang")
    return seeded_order(r, ["lang"], "doc_id", seed=42, pos_col="pos")


@query("split_counts")
def q_split_counts(spark, sf_dir):
    return split_counts(splitted(spark, sf_dir), ("lang",))


@query("merge_languages")
def q_merge_languages(spark, sf_dir):
    return merge_languages(splitted(spark, sf_dir).select("doc_id", "lang", "split"))


@query("split_leakage")
def q_split_leakage(spark, sf_dir):
    return split_leakage(splitted(spark, sf_dir), "doc_id", "input", source=fixtures.rec(spark, sf_dir).select("doc_id"))


@query("group_split")
def q_group_split(spark, sf_dir):
    """W2 that keeps copies of a text in one split."""
    return group_split(fixtures.rec(spark, sf_dir), text_col="input").select("doc_id", "split")


@query("group_split_leakage")
def q_group_split_leakage(spark, sf_dir):
    """U4 over the group-preserving split: no text is in two splits."""
    r = fixtures.rec(spark, sf_dir)
    return split_leakage(group_split(r, text_col="input"), "doc_id", "input", source=r.select("doc_id"))


@query("split_counts_totals")
def q_split_counts_totals(spark, sf_dir):
    return split_counts(splitted(spark, sf_dir), ("lang",), totals=True)


# ------------------------------------------------------------------ J
@query("pair_pred_ref")
def q_pair_pred_ref(spark, sf_dir):
    return evaluate.test_pairs(spark, sf_dir).select("run_id", "doc_id", "subtask", "output", "summary")


def _lists(spark, sf_dir):
    """Predictions and references as lists of files without ids: run 1 in id order, and all turns by conversation."""
    from corpusforge.session import shared_dir
    preds, refs = shared_dir(spark, "list-preds"), shared_dir(spark, "list-refs")
    p = fixtures.pred(spark, sf_dir).where("run_id = 1")
    p.repartitionByRange(5, "doc_id").sortWithinPartitions("doc_id").select("summary").write.json(preds, ignoreNullFields=False)
    turns = fixtures.table(spark, sf_dir, "conversations")
    (turns.repartitionByRange(3, "conv_id").sortWithinPartitions("conv_id", "turn").select(F.col("text").alias("output"))
     .write.parquet(refs))
    return spark.read.schema("summary string").json(preds), spark.read.schema("output string").parquet(refs)


@query("pair_by_position")
def q_pair_by_position(spark, sf_dir):
    """J4 by list position: two lists of files without ids, of unequal lengths."""
    return joins.pair_by_position(*_lists(spark, sf_dir))[0]


@query("pair_by_position_report")
def q_pair_by_position_report(spark, sf_dir):
    return joins.pair_by_position(*_lists(spark, sf_dir))[1]


@query("run_model_lookup")
def q_run_model_lookup(spark, sf_dir):
    return joins.run_model_lookup(fixtures.pred(spark, sf_dir).select("run_id", "doc_id"), spark)


@query("run_subtask_grid")
def q_run_subtask_grid(spark, sf_dir):
    cells = evaluate.test_pairs(spark, sf_dir).groupBy("run_id", "subtask").agg(
        F.count(F.lit(1)).alias("n_records"))
    grid = joins.run_subtask_grid(spark, cells)
    return grid.withColumn("n_records", F.coalesce("n_records", F.lit(0).cast("long")))


# ------------------------------------------------------------------ M
@query("rouge1")
def q_rouge1(spark, sf_dir):
    return scores.rouge_n(fixtures.paired_all(spark, sf_dir), 1)


@query("rouge2")
def q_rouge2(spark, sf_dir):
    return scores.rouge_n(fixtures.paired_all(spark, sf_dir), 2)


@query("rougeL")
def q_rougeL(spark, sf_dir):
    return scores.rouge_l(fixtures.paired_all(spark, sf_dir))


@query("rougeLsum")
def q_rougeLsum(spark, sf_dir):
    return scores.rouge_lsum(fixtures.paired_all(spark, sf_dir))


@query("rouge1_mixed_pairs")
def q_rouge1_mixed(spark, sf_dir):
    """M1 where predictions reorder and replace parts of their references."""
    return scores.rouge_n(fixtures.mixed_pairs(spark, sf_dir), 1)


@query("rouge2_mixed_pairs")
def q_rouge2_mixed(spark, sf_dir):
    return scores.rouge_n(fixtures.mixed_pairs(spark, sf_dir), 2)


@query("rougeL_mixed_pairs")
def q_rougeL_mixed(spark, sf_dir):
    """M3 on the same pairs; pytest holds the kernel to the plain programme on whole texts."""
    return scores.rouge_l(fixtures.mixed_pairs(spark, sf_dir))


@query("metric_suite_long")
def q_metric_suite_long(spark, sf_dir):
    return scores.metric_suite_long(fixtures.paired_all(spark, sf_dir))


@query("mean_scores")
def q_mean_scores(spark, sf_dir):
    s = scores.metric_suite_long(fixtures.paired_all(spark, sf_dir))
    return report.mean_scores(s, ["run_id"])


# ------------------------------------------------------------------ P
from corpusforge.config import (CropConfig, PrepConfig, RUN_MODELS, SUBTASKS_OFFICIAL,  # noqa: E402
                                SUBTASKS_UNOFFICIAL, SUMMARIZE_PROMPT, EXTRACT_PROMPT)
from corpusforge.functions import prompts, text  # noqa: E402
from corpusforge.operators import prep  # noqa: E402
from corpusforge.plans.prepare import prepare  # noqa: E402


def prepared(spark, sf_dir):
    return prepare(fixtures.rec(spark, sf_dir), PrepConfig())


@query("drop_column_strict")
def q_drop_column_strict(spark, sf_dir):
    return prep.drop_column_strict(fixtures.rec(spark, sf_dir), "rationale")


@query("drop_by_split")
def q_drop_by_split(spark, sf_dir):
    s = prep.drop_by_split(splitted(spark, sf_dir), PrepConfig().drop_columns)
    return s.select("doc_id", "split", "rationale", "rationale_prompt")


@query("crop_fields")
def q_crop_fields(spark, sf_dir):
    return prep.crop_fields(splitted(spark, sf_dir), CropConfig()).select("doc_id", "split", "input", "output")


@query("field_or_empty")
def q_field_or_empty(spark, sf_dir):
    """Length of 'rationale' in every split's read view (absent in test -> '' -> 0)."""
    p = prepared(spark, sf_dir)
    views = [prep.split_view(p, s, PrepConfig().drop_columns) for s in ("train", "valid", "test")]
    parts = [v.select("doc_id", "split", F.length(prep.field_or_empty(v, "rationale")).cast("long").alias("n_chars"))
             for v in views]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).filter(F.col("n_chars").isNotNull())


@query("rename_task_fields")
def q_rename_task_fields(spark, sf_dir):
    r = fixtures.rec(spark, sf_dir)
    return prep.rename_fields(r, {"doc_id": "doc_id", "rationale_prompt": "input", "rationale": "output"})


@query("summary_file_name")
def q_summary_file_name(spark, sf_dir):
    d = fixtures.table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("casesum_test_"), F.col("lang"), F.lit("/"), F.col("source"),
                           F.lit("."), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filepath"))
    return d.select("doc_id", "filepath", text.summary_file_name("filepath").alias("out_name"))


@query("subtask_lang")
def q_subtask_lang(spark, sf_dir):
    d = fixtures.table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("casesum_test_"), F.col("lang")).alias("subtask"))
    return d.select("doc_id", "subtask", text.subtask_lang("subtask").alias("lang"))


@query("domain_violations")
def q_domain_violations(spark, sf_dir):
    p = fixtures.pred(spark, sf_dir).join(
        fixtures.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    p = p.select("doc_id", "run_id", F.concat(F.lit("test_"), F.col("lang")).alias("subtask"))
    return prep.domain_violations(p, {"run_id": sorted(RUN_MODELS), "subtask": SUBTASKS_UNOFFICIAL},
                                  keys=("doc_id", "run_id"))


# ------------------------------------------------------------------ F
@query("sanitize_text")
def q_sanitize_text(spark, sf_dir):
    d = fixtures.table(spark, sf_dir, "documents")
    return d.select("doc_id", text.sanitize_text("text").alias("clean"))


@query("sentence_type_scores")
def q_sentence_type_scores(spark, sf_dir):
    """how much each type with a final period looks like an abbreviation, per language."""
    from corpusforge.operators import sentences
    docs = fixtures.table(spark, sf_dir, "documents")
    return (sentences.abbreviation_scores(sentences.type_counts(docs, "text", "lang"))
            .select("lang", "type", "with_dot", "without_dot", (F.round("score", 4) + F.lit(0.0)).alias("score")))


@query("trained_sentence_lines")
def q_trained_sentence_lines(spark, sf_dir):
    """one sentence a line, by boundaries learned from all documents of a language."""
    from corpusforge.operators import sentences
    docs = fixtures.spread(fixtures.table(spark, sf_dir, "documents")).select("doc_id", "lang", text.sanitize_text("text").alias("text"))
    return sentences.with_lines(docs, ["text"], "lang", sentences.learn(docs, "text", "lang")).select("doc_id", F.col("text").alias("lines"))


@query("rougeLsum_trained_sentences")
def q_rougeLsum_trained(spark, sf_dir):
    """M4 over learned sentence boundaries: predictions of all runs against whole references."""
    from corpusforge.operators import sentences
    docs = fixtures.spread(fixtures.table(spark, sf_dir, "documents")).select("doc_id", "lang", text.sanitize_text("text").alias("text"))
    model = sentences.learn(docs, "text", "lang")
    pairs = fixtures.paired_all(spark, sf_dir).select("run_id", "doc_id", "lang", *[text.sanitize_text(c).alias(c) for c in ("output", "summary")])
    return scores.rouge_lsum(sentences.with_lines(pairs, ["output", "summary"], "lang", model))


@query("sentence_lines")
def q_sentence_lines(spark, sf_dir):
    d = fixtures.table(spark, sf_dir, "documents")
    return d.select("doc_id", text.sentence_lines(text.sanitize_text("text")).alias("lines"))


@query("render_training_prompt")
def q_render_training_prompt(spark, sf_dir):
    r = fixtures.rec(spark, sf_dir)
    return r.select("doc_id", prompts.training_prompt(SUMMARIZE_PROMPT, "input", "output").alias("prompt"),
                    prompts.training_prompt(EXTRACT_PROMPT, "input", "rationale").alias("prompt_expl"))


@query("render_inference_prompt")
def q_render_inference_prompt(spark, sf_dir):
    r = joins.localised_prompt(fixtures.rec(spark, sf_dir).select("doc_id", "lang", "input"),
                               spark, on_missing="default")
    return r.select("doc_id", "lang", prompts.render_template(r, "{instruction}: {input}").alias("prompt"))


@query("localised_prompt")
def q_localised_prompt(spark, sf_dir):
    r = joins.localised_prompt(fixtures.rec(spark, sf_dir).select("doc_id", "lang"), spark, on_missing="default")
    return r.select("doc_id", "lang", "instruction")


@query("prompt_prefix")
def q_prompt_prefix(spark, sf_dir):
    r = fixtures.rec(spark, sf_dir).select(
        "doc_id", prompts.training_prompt(SUMMARIZE_PROMPT, "input", "output").alias("prompt"))
    return r.select("doc_id", prompts.prompt_prefix("prompt").alias("prefix"))


@query("marker_in_text")
def q_marker_in_text(spark, sf_dir):
    d = fixtures.table(spark, sf_dir, "documents")
    return d.filter(prompts.marker_in_text("text")).select("doc_id")


@query("build_chat_request")
def q_build_chat_request(spark, sf_dir):
    r = joins.localised_prompt(fixtures.rec(spark, sf_dir).select("doc_id", "lang", "input"),
                               spark, on_missing="default")
    r = r.select("doc_id", prompts.render_template(r, "{instruction}: {input}").alias("prompt"))
    return r.select("doc_id", prompts.chat_request(F.lit(RUN_MODELS[1]), "prompt").alias("body"))


def _replies(spark, sf_dir):
    """Stand-in replies: a chat completion per document; documents labelled toxic get '{}'."""
    d = fixtures.table(spark, sf_dir, "documents").select("doc_id", "text")
    lab = fixtures.table(spark, sf_dir, "labels").select("doc_id", "toxic")
    d = d.join(lab, "doc_id", "left")
    ok = F.to_json(F.struct(F.array(F.struct(F.struct(
        F.concat(F.lit(" "), F.col("text"), F.lit(" \n")).alias("content")).alias("message")))
        .alias("choices")))
    return d.select("doc_id", F.when(F.col("toxic") == 1, F.lit("{}")).otherwise(ok).alias("reply"))


@query("parse_chat_response")
def q_parse_chat_response(spark, sf_dir):
    r = _replies(spark, sf_dir)
    return r.select("doc_id", prompts.chat_reply_content("reply").alias("content")) \
        .filter(F.col("content").isNotNull())


@query("parse_chat_rejects")
def q_parse_chat_rejects(spark, sf_dir):
    """Replies without a message, kept as they came."""
    r = _replies(spark, sf_dir)
    return r.filter(prompts.chat_reply_content("reply").isNull()).select("doc_id", "reply")


@query("rouge_tokens")
def q_rouge_tokens(spark, sf_dir):
    d = fixtures.table(spark, sf_dir, "documents").select("doc_id", text.rouge_tokens("text").alias("t"))
    return d.select("doc_id", F.array_join("t", " ").alias("tokens"), F.size("t").cast("long").alias("n_tokens"))


# ------------------------------------------------------------------ A1/A2/W3/O3
@query("length_stats")
def q_length_stats(spark, sf_dir):
    return report.length_stats(fixtures.rec(spark, sf_dir), ["lang"], "input")


@query("length_report")
def q_length_report(spark, sf_dir):
    p = prepared(spark, sf_dir).withColumn(
        "dataset", F.when(F.col("split") == "test", F.concat(F.lit("test_"), F.col("lang"))).otherwise(F.col("split")))
    return report.length_report(p, ["dataset"], ["input", "output", "rationale"])


@query("length_report_totals")
def q_length_report_totals(spark, sf_dir):
    """A2 per (split, language), per split and for all records, with rows for empty sets."""
    return report.length_report_totals(prepared(spark, sf_dir), ["split", "lang"], ["input", "output", "rationale"])


@query("rank_percentile")
def q_rank_percentile(spark, sf_dir):
    d = fixtures.table(spark, sf_dir, "documents").select("lang", F.length("text").alias("n_chars"))
    return report.rank_percentiles(d, ["lang"], "n_chars")


@query("longest_records")
def q_longest_records(spark, sf_dir):
    return report.longest_records(prepared(spark, sf_dir), ["split"], "input", "doc_id", 5)


# ------------------------------------------------------------------ A5-A9, W4/W5, T7
@query("rouge_avg_percent")
def q_rouge_avg_percent(spark, sf_dir):
    wide = scores.metric_suite(fixtures.paired_all(spark, sf_dir))
    means = wide.groupBy("run_id").agg(*[F.avg(m).alias(m) for m in ("rouge1", "rouge2", "rougeL")])
    return report.rouge_avg_percent(means)


@query("combined_loss")
def q_combined_loss(spark, sf_dir):
    c = report.combined_loss(fixtures.losslog(spark, sf_dir), alpha=0.8)
    return c.select("step", *[F.round(x, 6).alias(x) for x in ("loss", "loss_pred", "loss_expl")])


@query("token_accuracy")
def q_token_accuracy(spark, sf_dir):
    return report.token_accuracy(fixtures.logits(spark, sf_dir), [], "logits", "label")


@query("token_accuracy_shift")
def q_token_accuracy_shift(spark, sf_dir):
    """A8 against the next label; a run of 50 vector ids stands in for a sequence."""
    x = fixtures.logits(spark, sf_dir).withColumn("seq", F.floor(F.col("vec_id") / 50))
    return report.token_accuracy(x, [], "logits", "label", shift_by=(["seq"], "vec_id"))


@query("training_log_full")
def q_training_log_full(spark, sf_dir):
    """A9 with accuracies, learning rate and the evaluation rows of every 250th step."""
    losses = fixtures.losslog(spark, sf_dir)
    acc = losses.select("step", "task", (F.col("loss") - F.floor("loss")).alias("accuracy"))
    rates = fixtures.table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), (1e-5 / (F.col("event_id") + 1)).alias("learning_rate"))
    t = report.training_log_long(losses, 0.8, "train", acc, rates).unionByName(
        report.training_log_long(losses.where("step % 250 = 0"), 0.8, "eval"))
    return t.select("step", "name", F.round("value", 6).alias("value"))


@query("result_log_roundtrip")
def q_result_log_roundtrip(spark, sf_dir):
    """The leaderboard as a result log, written and read back."""
    path = shared_dir(spark, "result-log")
    sinks.write_result_log(evaluate.leaderboard(spark, sf_dir), path)
    return spark.read.schema("run_id long, subtask string, rouge1 double, rouge2 double, rougeL double, model string").json(path)


@query("scan_text_folder_utf16")
def q_scan_text_folder_utf16(spark, sf_dir):
    folder = shared_dir(spark, "text-folder-16")
    sinks.export_text_files(_case_files(spark, sf_dir), _posix(folder), "filename", "text", encoding="utf-16")
    return readers.read_text_folder(spark, folder, encoding="UTF-16").select("filename", "input")


@query("training_log_long")
def q_training_log_long(spark, sf_dir):
    t = report.training_log_long(fixtures.losslog(spark, sf_dir), alpha=0.8)
    return t.select("step", "name", F.round("value", 6).alias("value"))


@query("best_checkpoint")
def q_best_checkpoint(spark, sf_dir):
    return report.best_checkpoint(fixtures.evalhist(spark, sf_dir), eval_steps=250, eval_delay=1)


@query("retained_checkpoints")
def q_retained_checkpoints(spark, sf_dir):
    return report.retained_checkpoints(fixtures.evalhist(spark, sf_dir), eval_steps=250, eval_delay=1)


@query("logits_argmax")
def q_logits_argmax(spark, sf_dir):
    return fixtures.logits(spark, sf_dir).select("vec_id", report.argmax("logits").alias("pred_id"), "label")


# ------------------------------------------------------------------ T
from corpusforge.config import TrainConfig  # noqa: E402
from corpusforge.operators import tokens  # noqa: E402
from corpusforge.plans import encode as enc  # noqa: E402

VOCAB_K = 5000
MAX_IN = TrainConfig().max_input_length
MAX_OUT = TrainConfig().max_output_length


def _vocab(spark, sf_dir):
    """The whole vocabulary, made once for all uses in a query."""
    return tokens.Vocabulary(enc.vocabulary(fixtures.rec(spark, sf_dir, spread_out=True)))


def _encoded(spark, sf_dir, mask_mode="prompt"):
    return enc.encode_task(fixtures.rec(spark, sf_dir, spread_out=True), _vocab(spark, sf_dir), "pred", MAX_IN, mask_mode)


@query("build_vocabulary")
def q_build_vocabulary(spark, sf_dir):
    return enc.vocabulary(fixtures.rec(spark, sf_dir), VOCAB_K)


@query("encode_tokens")
def q_encode_tokens(spark, sf_dir):
    p = enc.prompts(fixtures.rec(spark, sf_dir), "pred")
    e = tokens.encode(p, "pieces", _vocab(spark, sf_dir), keep=False)
    return e.select("doc_id", F.size("ids").cast("long").alias("n_ids"), tokens.ids_text("ids").alias("ids"))


@query("pad_truncate")
def q_pad_truncate(spark, sf_dir):
    e = _encoded(spark, sf_dir)
    return e.select("doc_id", tokens.ids_text("input_ids").alias("input_ids"),
                    tokens.ids_text("attention_mask").alias("attention_mask"))


@query("mask_labels")
def q_mask_labels(spark, sf_dir):
    e = _encoded(spark, sf_dir)
    pl = F.least(F.col("prefix_len"), F.lit(MAX_IN))
    return e.select("doc_id",
                    tokens.ids_text(tokens.mask_labels("input_ids", pl, "prompt")).alias("labels_prompt"),
                    tokens.ids_text(tokens.mask_labels("input_ids", pl, "as_written")).alias("labels_as_written"),
                    tokens.ids_text(tokens.mask_labels("input_ids", pl, "full")).alias("labels_full"))


@query("unmask_labels")
def q_unmask_labels(spark, sf_dir):
    e = _encoded(spark, sf_dir)
    return e.select("doc_id", tokens.ids_text(tokens.unmask_labels("labels")).alias("ids"))


@query("decode_tokens")
def q_decode_tokens(spark, sf_dir):
    v = _vocab(spark, sf_dir)
    e = enc.encode_task(fixtures.rec(spark, sf_dir), v, "pred", MAX_IN).select("doc_id", tokens.unmask_labels("labels").alias("u"))
    return tokens.decode(e, "u", v, "text").select("doc_id", "text")


@query("truncation_audit")
def q_truncation_audit(spark, sf_dir):
    r = fixtures.rec(spark, sf_dir)
    p = enc.prompts(r, "pred", extra=("lang",)).select("lang", F.size("pieces").alias("n"), "prefix_len")
    return tokens.truncation_audit(p, ["lang"], "n", "prefix_len", MAX_IN)


@query("two_task_examples")
def q_two_task_examples(spark, sf_dir):
    w = enc.two_task_wide(fixtures.rec(spark, sf_dir), _vocab(spark, sf_dir), MAX_IN)
    lg = enc.two_task_long(w)
    return lg.select("doc_id", "task", F.col("n_tokens").cast("long").alias("n_tokens"),
                     F.col("prefix_len").cast("long").alias("prefix_len"),
                     F.size(F.filter("labels", lambda x: x != -100)).cast("long").alias("n_label_tokens"),
                     report.nonpad_len("input_ids").cast("long").alias("n_input_tokens"))


@query("select_mode_columns")
def q_select_mode_columns(spark, sf_dir):
    e = _encoded(spark, sf_dir)
    s = prep.select_mode_columns(e, "standard")
    return s.select("doc_id", *[tokens.ids_text(c).alias(c) for c in ("input_ids", "attention_mask", "labels")])


@query("mean_nonpad_len")
def q_mean_nonpad_len(spark, sf_dir):
    v = _vocab(spark, sf_dir)
    pr = fixtures.paired_all(spark, sf_dir).select(
        "run_id", tokens.word_pieces("summary").alias("ps"), tokens.word_pieces("output").alias("po"))
    pr = tokens.encode(pr, ["ps", "po"], v, ["is", "io"], keep=False)
    pr = pr.select("run_id", tokens.pad_truncate(F.col("is"), MAX_OUT)[0].alias("pred_ids"),
                   tokens.pad_truncate(F.col("io"), MAX_OUT)[0].alias("label_ids"))
    return report.mean_nonpad_len(pr, ["run_id"], "pred_ids", "label_ids")


# ------------------------------------------------------------------ S / J1 / I
from corpusforge.operators import annotate as ann  # noqa: E402
from corpusforge.session import shared_dir  # noqa: E402
from corpusforge.sources import readers, sinks  # noqa: E402

ANSWER_CHARS = 256
MAX_PROMPT_CHARS = 20000


def _posix(path: str) -> str:
    if path.startswith("file:"):
        return "/" + path[len("file:"):].lstrip("/")
    if "://" in path:
        raise NotImplementedError("text-file export needs a POSIX-mounted shared folder")
    return path


def _model():
    return ann.PrefixModel(ANSWER_CHARS)


def _flaky_model():
    return ann.PrefixModel(ANSWER_CHARS, max_prompt_chars=MAX_PROMPT_CHARS)


def _case_files(spark, sf_dir, lang=None):
    d = fixtures.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    if lang:
        d = d.filter(F.col("lang") == lang)
    return d.select("doc_id", "lang", F.concat(F.lit("case_"), F.col("doc_id").cast("string"),
                                               F.lit(".txt")).alias("filename"), "text")


def _json_array_files(spark, sf_dir):
    path = shared_dir(spark, "json-arrays")
    files = sinks.write_json_arrays(fixtures.rec(spark, sf_dir), path, "lang", "doc_id", name="casesum_gs", compression="gzip")
    return path, files


@query("scan_json_records")
def q_scan_json_records(spark, sf_dir):
    path, _ = _json_array_files(spark, sf_dir)
    return readers.read_json_records(spark, f"{path}/*.json*").select(
        "doc_id", "input", "output", "rationale", "rationale_prompt")


@query("scan_manifest_lang")
def q_scan_manifest_lang(spark, sf_dir):
    path, files = _json_array_files(spark, sf_dir)
    names = [f.rsplit("/", 1)[1] for f in files]
    return readers.read_manifest(spark, path, names).select("doc_id", "lang")


@query("scan_text_folder")
def q_scan_text_folder(spark, sf_dir):
    folder = shared_dir(spark, "text-folder")
    sinks.export_text_files(_case_files(spark, sf_dir), _posix(folder), "filename", "text")
    with open(_posix(folder) + "/broken.txt", "wb") as f:  # one undecodable file, skipped on read
        f.write(b"\xff\xfe\xfa")
    return readers.read_text_folder(spark, folder).select("filename", "input")


@query("load_train_valid")
def q_load_train_valid(spark, sf_dir):
    path = shared_dir(spark, "splits")
    sinks.write_splits(prepared(spark, sf_dir), path)
    return readers.load_train_valid(spark, path).select("doc_id", "lang", "split")


@query("sink_splits_roundtrip")
def q_sink_splits_roundtrip(spark, sf_dir):
    path = shared_dir(spark, "splits")
    sinks.write_splits(prepared(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy("split", "lang").agg(F.count(F.lit(1)).alias("n"))


@query("scan_predictions")
def q_scan_predictions(spark, sf_dir):
    path = shared_dir(spark, "predictions")
    p = fixtures.pred(spark, sf_dir).join(fixtures.table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    sinks.write_predictions(p.select("doc_id", "summary", "run_id",
                                     F.concat(F.lit("test_"), F.col("lang")).alias("subtask")), path)
    return readers.read_predictions(spark, path, "test_en", 2).select("doc_id", "summary")


@query("sink_json_roundtrip")
def q_sink_json_roundtrip(spark, sf_dir):
    path = shared_dir(spark, "json-lines")
    sinks.write_json_lines(fixtures.rec(spark, sf_dir), path)
    schema = "doc_id long, lang string, input string, output string, rationale string, rationale_prompt string"
    return spark.read.schema(schema).json(path).select("doc_id", "lang", "input", "output", "rationale")


@query("sink_submission_roundtrip")
def q_sink_submission_roundtrip(spark, sf_dir):
    path = shared_dir(spark, "submission")
    p = fixtures.pred(spark, sf_dir).join(_case_files(spark, sf_dir).drop("text"), "doc_id")
    p = p.select("run_id", "lang", text.summary_file_name("filename").alias("out_name"), "summary")
    sinks.write_predictions(p, path, by=("run_id", "lang"))
    return spark.read.parquet(path).select("run_id", "lang", "out_name", "summary")


def _done_names(spark, sf_dir):
    lab = fixtures.table(spark, sf_dir, "labels").filter(F.col("quality") == 1)
    return lab.select(F.concat(F.lit("case_"), F.col("doc_id").cast("string"), F.lit("_sum.txt")).alias("out_name"))


@query("resume_anti_join")
def q_resume_anti_join(spark, sf_dir):
    inputs = _case_files(spark, sf_dir).select("doc_id", "filename")
    return joins.resume_anti_join(inputs, _done_names(spark, sf_dir), text.summary_file_name("filename"))


@query("annotate_records")
def q_annotate_records(spark, sf_dir):
    r = prep.drop_column_strict(fixtures.rec(spark, sf_dir), "rationale")
    a = ann.materialize(ann.annotate(r, EXTRACT_PROMPT + ": {input}", "rationale", _model, batch_size=8))
    good, _ = ann.split_rejects(a, "rationale")
    return good.select("doc_id", "rationale", "rationale_prompt")


@query("annotate_records_concurrent")
def q_annotate_records_concurrent(spark, sf_dir):
    """I1/H2 with four calls in flight a task; the same rows as the serial form."""
    r = prep.drop_column_strict(fixtures.rec(spark, sf_dir), "rationale")
    a = ann.materialize(ann.annotate(r, EXTRACT_PROMPT + ": {input}", "rationale", _model, batch_size=8, in_flight=4))
    good, _ = ann.split_rejects(a, "rationale")
    return good.select("doc_id", "rationale", "rationale_prompt")


@query("annotate_rejects")
def q_annotate_rejects(spark, sf_dir):
    r = fixtures.rec(spark, sf_dir).select("doc_id", "input")
    a = ann.materialize(ann.annotate(r, EXTRACT_PROMPT + ": {input}", "rationale", _flaky_model,
                                     batch_size=8, attempts=3))
    _, bad = ann.split_rejects(a, "rationale")
    return bad.select("doc_id", "error", F.col("attempts").cast("long").alias("attempts"))


@query("annotate_chain")
def q_annotate_chain(spark, sf_dir):
    r = fixtures.rec(spark, sf_dir).select("doc_id", "input")
    steps = [{"prompt": EXTRACT_PROMPT + ": {input}", "out": "rationale"},
             {"prompt": SUMMARIZE_PROMPT + ": {rationale}", "out": "summary"}]
    a = ann.materialize(ann.annotate_chain(r, steps, _model))
    return a.select("doc_id", "rationale", "summary")


@query("annotate_chain_rejects")
def q_annotate_chain_rejects(spark, sf_dir):
    """Records of a chain that a step refused, with the step and its error."""
    r = fixtures.rec(spark, sf_dir).select("doc_id", "input")
    steps = [{"prompt": EXTRACT_PROMPT + ": {input}", "out": "rationale"},
             {"prompt": SUMMARIZE_PROMPT + ": {rationale}", "out": "summary"}]
    a = ann.materialize(ann.annotate_chain(r, steps, _flaky_model))
    _, bad = ann.split_rejects(a, "summary")
    return bad.select("doc_id", "error", F.col("attempts").cast("long").alias("attempts"))


def _run_model(n):
    return lambda: ann.PrefixModel(n)


@query("predict_and_score")
def q_predict_and_score(spark, sf_dir):
    """The unofficial flow as one query; run k's stand-in model answers with 256 k characters."""
    return evaluate.predict_and_score(spark, sf_dir, {k: _run_model(ANSWER_CHARS * k) for k in RUN_MODELS}, ("rouge1", "rouge2"))


@query("reannotate")
def q_reannotate(spark, sf_dir):
    r = prep.drop_column_strict(fixtures.rec(spark, sf_dir), "rationale")
    a = ann.materialize(ann.annotate(r, EXTRACT_PROMPT + ": {input}", "rationale", _model))
    good, _ = ann.split_rejects(a, "rationale")
    path = shared_dir(spark, "reannotated")
    sinks.write_json_lines(good, path)
    schema = "doc_id long, lang string, input string, output string, rationale string, rationale_prompt string"
    return spark.read.schema(schema).json(path)


@query("summarise_resume")
def q_summarise_resume(spark, sf_dir):
    """I5 for subtask casesum_test_en: scan folder, skip done, localised prompt, annotate, export."""
    subtask = "casesum_test_en"
    folder, target = shared_dir(spark, subtask), shared_dir(spark, "submissions")
    sinks.export_text_files(_case_files(spark, sf_dir, "en"), _posix(folder), "filename", "text")
    done = _done_names(spark, sf_dir).withColumn("summary", F.lit("done earlier"))
    sinks.export_text_files(done, _posix(target), "out_name", "summary")
    inputs = readers.read_text_folder(spark, folder)
    done_now = readers.folder_names(spark, target).select(F.col("filename").alias("out_name"))
    todo = joins.resume_anti_join(inputs, done_now, text.summary_file_name("filename"))
    todo = todo.withColumn("lang", text.subtask_lang(F.lit(subtask)))
    todo = joins.localised_prompt(todo, spark)
    a = ann.materialize(ann.annotate(todo, "{instruction}: {input}", "summary", _model))
    good, _ = ann.split_rejects(a, "summary")
    good = good.withColumn("out_name", text.summary_file_name("filename"))
    sinks.export_text_files(good, _posix(target), "out_name", "summary")
    return good.select("out_name", "summary")


# ------------------------------------------------------------------ G
from corpusforge.streaming import jobs as stream  # noqa: E402


def _landed(spark, df, name, times=1, files=4):
    path = shared_dir(spark, name)
    for _ in range(times):
        df.repartition(files).write.mode("append").parquet(path)
    return path


@query("stream_annotate")
def q_stream_annotate(spark, sf_dir):
    r = fixtures.rec(spark, sf_dir).select("doc_id", "input")
    src = _landed(spark, r, "stream-in")
    out = stream.stream_annotate(spark, src, r.schema, EXTRACT_PROMPT + ": {input}", "rationale", _model,
                                 shared_dir(spark, "stream-out"), shared_dir(spark, "stream-ckpt"))
    return out.select("doc_id", "rationale")


@query("stream_dedup")
def q_stream_dedup(spark, sf_dir):
    r = fixtures.rec(spark, sf_dir).select("doc_id", "lang")
    src = _landed(spark, r, "stream-dup", times=2)
    out = stream.stream_dedup(spark, src, r.schema, "doc_id", shared_dir(spark, "dedup-out"),
                              shared_dir(spark, "dedup-ckpt"))
    return out.select("doc_id", "lang")


@query("stream_leaderboard")
def q_stream_leaderboard(spark, sf_dir):
    preds = fixtures.pred(spark, sf_dir)
    path = shared_dir(spark, "stream-preds")
    for run in sorted(RUN_MODELS):  # one landing per run
        preds.filter(F.col("run_id") == run).repartition(2).write.mode("append").parquet(path)
    refs = evaluate.test_references(spark, sf_dir).select("doc_id", "subtask", "output")
    return stream.stream_leaderboard(spark, path, preds.schema, refs, shared_dir(spark, "lb-state"),
                                     shared_dir(spark, "lb-ckpt"), files_per_batch=2)


# ------------------------------------------------------------------ A10 / M5 / F10 / eval
@query("bootstrap_ci")
def q_bootstrap_ci(spark, sf_dir):
    r1 = scores.rouge_n(fixtures.paired_all(spark, sf_dir), 1)
    b = scores.bootstrap_ci(r1, ["run_id"], "doc_id", "rouge1", replicates=100, seed=42)
    return b.select("run_id", *[F.round(c, 6).alias(c) for c in ("low", "mid", "high")])


@query("greedy_embedding_match")
def q_greedy_embedding_match(spark, sf_dir):
    g = scores.greedy_embedding_match(fixtures.token_lists(spark, sf_dir), vectors=fixtures.token_vectors(spark, sf_dir))
    return g.select("run_id", "doc_id", *[F.round(c, 4).alias(c) for c in
                                           ("bertscore_precision", "bertscore_recall", "bertscore_f1")])


@query("stemmed_vocabulary")
def q_stemmed_vocabulary(spark, sf_dir):
    """every distinct ROUGE token of the corpus stemmed once (Porter 1980)."""
    d = fixtures.table(spark, sf_dir, "documents")
    toks = d.select(F.explode(text.rouge_tokens("text")).alias("token")).distinct()
    return toks.select("token", F.element_at(scores._stem_udf(F.array("token")), 1).alias("stem"))


@query("eval_predictions")
def q_eval_predictions(spark, sf_dir):
    """compute_metrics as a job: unmask -> decode -> sanitize -> sentence lines -> ROUGE (stemmed) -> x100."""
    pr = fixtures.paired_all(spark, sf_dir).select(
        "run_id", "doc_id", tokens.text_pieces("summary").alias("ps"), tokens.text_pieces("output").alias("po"))
    v = tokens.Vocabulary(tokens.build_vocabulary(pr.select(F.concat("ps", "po").alias("p")), "p", None))
    pr = tokens.encode(pr, ["ps", "po"], v, ["is", "io"], keep=False)
    pr = pr.select("run_id", "doc_id",
                   tokens.pad_truncate(F.col("is"), MAX_OUT)[0].alias("pred_ids"),
                   tokens.mask_labels(tokens.pad_truncate(F.col("io"), MAX_OUT)[0], F.lit(0), "full").alias("label_ids"))
    pr = tokens.decode(pr.withColumn("label_u", tokens.unmask_labels("label_ids")), ["pred_ids", "label_u"], v, ["pred_text", "label_text"])
    pr = pr.select("run_id", "doc_id", "pred_ids", "label_u",
                   text.sentence_lines(text.sanitize_text("pred_text")).alias("summary"),
                   text.sentence_lines(text.sanitize_text("label_text")).alias("output"))
    # the ids go along, so that scores and lengths are averaged in one pass over the pairs
    names = ("rouge1", "rouge2", "rougeL", "rougeLsum")
    wide = scores.metric_suite(pr, keys=("run_id", "doc_id", "pred_ids", "label_u"), metrics=names, stem=True)
    lens = report.mean_nonpad_len(wide, ["run_id"], "pred_ids", "label_u", also=tuple(F.avg(m).alias(m) for m in names))
    return report.rouge_avg_percent(lens).select("run_id", *names, "rouge_avg", "mean_generated_len", "mean_reference_len")
