"""Command line: ``python -m newsloom COMMAND``. Commands compose operators; each returns its exit code.

Models are named as ``module:function``, which returns a classifier (see operators/predict.py), and rules are a JSON file.
"""

from __future__ import annotations

import argparse
import importlib
import json
import logging
import os
import sys
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions import text as T
from newsloom.functions import values as V
from newsloom.operators import audit, calibrate, decide, extract, governance, metrics, pipeline, predict, profiles, reports, ruleset
from newsloom.operators.ruleset import REVIEW, RuleSet
from newsloom.shipping import ship
from newsloom.sources import feeds, sinks

FAILURES = (OSError, ValueError, RuntimeError, feeds.CollectionError, PySparkException)


def configure_logging(level: int = logging.INFO) -> None:
    logging.basicConfig(format="{levelname:.1} {asctime} {module}: {message}", style="{", level=level, stream=sys.stderr, force=True)
    logging.getLogger("py4j").setLevel(logging.ERROR)


def session() -> SparkSession:
    return SparkSession.builder.appName("newsloom").getOrCreate()


def _limit(x: str) -> int:
    try:
        return V.validate_limit(int(x))
    except ValueError as e:
        raise argparse.ArgumentTypeError(str(e)) from e


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="newsloom", description="Collect, classify and audit news articles.")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, about: str, model: bool = False, rules: bool = False) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=about)
        p.set_defaults(run=run)
        if model:
            p.add_argument("--classifier", default=os.environ.get("NEWSLOOM_CLASSIFIER"), metavar="MODULE:FUNCTION", help="returns a classifier; default: $NEWSLOOM_CLASSIFIER")
        if model or rules:
            p.add_argument("--rules", default=os.environ.get("NEWSLOOM_RULES"), help="rule set (JSON); default: $NEWSLOOM_RULES")
        return p

    p = command("collect", collect, "collect and classify the articles of a keyword", model=True)
    p.add_argument("--keyword")
    p.add_argument("--limit", type=_limit, default=10)
    p.add_argument("--csv", default="news_analysis_results.csv")
    p.add_argument("--store", help="cumulative store to add the rows to")
    p.add_argument("--feeds", help="landed feeds (RSS) to read")
    p.add_argument("--pages", help="landed pages (Parquet: url, html, status, http_status) to take bodies from")
    p.add_argument("--enrich-content", action="store_true")
    p.add_argument("--no-review-enrichment", action="store_true")
    for x in ("confidence", "decision", "rule"):
        p.add_argument(f"--{x}-profile")

    p = command("dashboard", dashboard, "tables of stored results")
    p.add_argument("--csv", default="news_analysis_results.csv")
    p.add_argument("--category", action="append", default=[])
    p.add_argument("--shown", type=int, default=20, help="articles and groups printed")

    p = command("evaluate", evaluate, "compare methods on reviewed cases", model=True)
    p.add_argument("--dataset", required=True)
    p.add_argument("--split", choices=audit.SPLITS, default="evaluation")
    p.add_argument("--output-dir", default="evaluation_results")
    p.add_argument("--compare-legacy", action="store_true")
    p.add_argument("--compare-short-labels", metavar="MODULE:FUNCTION", help="a classifier by short labels")
    p.add_argument("--require-unseen-keywords", action="store_true")
    p.add_argument("--require-independent-events", action="store_true")
    p.add_argument("--min-events-per-label", type=int, default=2)
    p.add_argument("--decision-profile")
    p.add_argument("--rules-file", help="proposed rules to evaluate")
    p.add_argument("--export-rule-profile", help="where to write a profile of them if they pass")

    p = command("calibrate-confidence", calibrate_confidence, "thresholds of confidence tiers", model=True)
    p.add_argument("--dataset", required=True)
    p.add_argument("--output", default="evaluation_results/confidence_calibration.json")
    p.add_argument("--minimum-support", type=int, default=15)
    p.add_argument("--high-lower-bound", type=float, default=0.80)
    p.add_argument("--medium-lower-bound", type=float, default=0.65)
    p.add_argument("--force", action="store_true")

    p = command("calibrate-decision", calibrate_decision, "thresholds of the final decision", model=True)
    p.add_argument("--dataset", required=True)
    p.add_argument("--output", default="evaluation_results/decision_calibration.json")
    p.add_argument("--minimum-support", type=int, default=30)
    p.add_argument("--accuracy-lower-bound", type=float, default=0.85)
    p.add_argument("--input-mode", choices=["without_body", "with_body"], default="without_body")
    p.add_argument("--force", action="store_true")

    p = command("collect-evaluation", collect_evaluation, "candidates for review, in turn from several keywords")
    p.add_argument("--output", required=True)
    p.add_argument("--target-total", type=int, default=180)
    p.add_argument("--per-query", type=_limit, default=40)
    p.add_argument("--query", action="append", required=True)
    p.add_argument("--feeds", help="folder of landed feeds, one folder per keyword")
    p.add_argument("--pages", help="landed pages to take bodies from")
    p.add_argument("--overwrite", action="store_true")

    p = command("prepare-review", prepare_review, "review sheet without predictions", rules=True)
    p.add_argument("--dataset", action="append", required=True)
    p.add_argument("--confirmed-json", action="append", default=[])
    p.add_argument("--output", required=True)
    p.add_argument("--min-events-per-label", type=int, default=2)

    p = command("check-review", check_review, "whether a review can be evaluated", rules=True)
    p.add_argument("--dataset", required=True)
    p.add_argument("--report")
    p.add_argument("--min-events-per-label", type=int, default=2)

    p = command("review-candidates", review_candidates, "audit proposed phrases", rules=True)
    p.add_argument("--dataset", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--candidate", action="append", required=True, metavar="CATEGORY:PHRASE")

    p = command("audit-reasons", audit_reasons, "why stored articles were held for review", rules=True)
    p.add_argument("--input", nargs="+", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--score-threshold", type=float, default=0.5)
    p.add_argument("--margin-threshold", type=float, default=0.05)

    p = command("compare-body", compare_body, "what bodies changed in stored decisions")
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)

    p = command("compare-context", compare_context, "the anchored rules, an experiment, against the present ones", model=True)
    p.add_argument("--dataset", required=True)
    p.add_argument("--output", required=True)
    return top


# --- parts ------------------------------------------------------------------------------------------


def _named(spec: str | None):
    module, colon, name = (spec or "").partition(":")
    if not colon:
        raise ValueError("a classifier is needed: --classifier module:function")
    return getattr(importlib.import_module(module), name)()


def _rules(args: argparse.Namespace) -> RuleSet:
    if not args.rules:
        raise ValueError("a rule set is needed: --rules file")
    return ruleset.load(args.rules)


def _new(path: str, force: bool = False, *sources: str) -> str:
    if os.path.exists(path) and not force:
        raise FileExistsError(f"{path} exists")
    if os.path.realpath(path) in map(os.path.realpath, sources):
        raise ValueError(f"{path} is an input")
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    return path


def _model(args: argparse.Namespace) -> str:
    return args.classifier or ""


def _articles(spark: SparkSession, path: str) -> DataFrame:
    """A reviewed dataset with every article column."""
    df = feeds.read_reviewed(spark, path)
    names = [*feeds.ARTICLE.fieldNames(), "event_id", "suggested_label"]
    return df.withColumns({c: F.lit("") for c in names if c not in df.columns})


def _print(rows: DataFrame, title: str, shown: int | None = None) -> None:
    got = (rows if shown is None else rows.limit(shown)).collect()
    print(f"## {title}\n\n{metrics.markdown([tuple(reports.cell('' if x is None else x) for x in r) for r in got], rows.columns)}")


def _sound(df: DataFrame, labels: list[str]) -> DataFrame:
    """Predictions, written out and checked."""
    df = pipeline.dedup.written(df)
    r = predict.check(df, labels).first()
    if r["failed"] or r["unknown_labels"] or r["bad_scores"]:
        raise RuntimeError(f"the model failed: {r.asDict()}")
    return df


def _load_profiles(args: argparse.Namespace, rules: RuleSet) -> dict:
    """rules, tiers, relaxed and input_mode under the profiles of a run."""
    out: dict = {"tiers": ((0.70, 0.10), (0.50, 0.05)), "relaxed": None, "input_mode": None}
    out["rules"] = rules = profiles.load_rule_profile(getattr(args, "rule_profile", None), rules, governance.bindings(rules, _model(args)))
    if getattr(args, "confidence_profile", None):
        out["tiers"] = governance.confidence_profile(args.confidence_profile, governance.bindings(rules, _model(args)))
    if args.decision_profile:
        with open(args.decision_profile, encoding="utf-8") as f:
            mode = json.load(f).get("bindings", {}).get("input_mode")
        if mode not in ("with_body", "without_body"):
            raise governance.Rejected("the decision profile names no input mode")
        out["relaxed"], out["input_mode"] = governance.load_decision_profile(args.decision_profile, rules, governance.bindings(rules, _model(args), mode)), mode
    return out


# --- commands ---------------------------------------------------------------------------------------


def collect(args: argparse.Namespace) -> int:
    keyword = V.require_non_blank(input("keyword: ") if args.keyword is None else args.keyword, "keyword")
    spark = session()
    p = _load_profiles(args, _rules(args))
    settings = pipeline.Settings(p["rules"], _named(args.classifier), relaxed=p["relaxed"], input_mode=p["input_mode"], enrich_all=args.enrich_content, retry=not args.no_review_enrichment)
    ship(spark)
    source = feeds.LandedFeeds(V.require_non_blank(args.feeds or "", "--feeds"))
    try:
        articles = source.fetch(spark, keyword, args.limit)
        articles = articles.withColumn("ord", F.col("ord.file") * 128 + F.col("ord.place"))  # a feed gives at most 100 items
    except feeds.CollectionError as e:
        print(f"Pipeline status: {'NETWORK_ERROR' if isinstance(e, feeds.NetworkError) else 'COLLECTION_ERROR'}\n{e}\nNothing was saved.", file=sys.stderr)
        return 1
    pages = spark.read.parquet(args.pages) if args.pages else None
    result = pipeline.run(articles, settings, pages, created_at=datetime.now(timezone.utc).isoformat(timespec="seconds"))
    print(f"Pipeline status: {result.status}")
    if not result.succeeded:
        print(f"{result.stage} {result.cause}: {result.error}\nNothing was saved.", file=sys.stderr)
        return 1
    none = spark.createDataFrame([], ", ".join(f"{c} string" for c in feeds.RESULT))
    rows = none if result.rows is None else pipeline.dedup.written(sinks.result_rows(result.rows, p["tiers"]))
    print(f"CSV saved: {sinks.write_csv(rows, args.csv)}")
    if args.store and result.rows is not None:
        sinks.Store(args.store).save(rows.withColumn("ord", F.monotonically_increasing_id()))
        print(f"Store saved: {args.store}")
    if result.rows is not None:
        print(reports.summary_markdown(rows))
    return 0


def dashboard(args: argparse.Namespace) -> int:
    shown = reports.dashboard(feeds.read_results(session(), args.csv), args.category)
    for name, rows in shown.items():
        _print(rows, name, None if name in ("totals", "categories") else args.shown)
    return 0


def evaluate(args: argparse.Namespace) -> int:
    if args.export_rule_profile and (not args.rules_file or args.split != "evaluation"):
        raise ValueError("a profile needs --rules-file and the evaluation split")
    base = _rules(args)
    rules = profiles.read_proposals(args.rules_file, base) if args.rules_file else base
    labels, spark = list(rules.labels), session()
    ship(spark)
    all_rows = _articles(spark, args.dataset)
    has_rules = any(t.origin == "development" for t in rules.terms)
    apart = args.require_independent_events or (has_rules and args.split == "evaluation")
    cases = governance.require_cases(all_rows, args.split, labels, explicit_events=apart)
    ready = reports.require_ready(all_rows, labels, args.min_events_per_label) if args.require_independent_events else None
    if apart or args.require_unseen_keywords:
        other = all_rows.where(F.trim("split") == "development")
        governance.require_none(governance.unseen_keywords(other, all_rows.where(F.trim("split") == "evaluation")), "keywords of both splits")
    profile = _load_profiles(args, rules)
    if profile["relaxed"]:
        rules = rules.with_policy(**vars(profile["relaxed"]))
        cases = governance.for_mode(cases, profile["input_mode"])
    short = _named(args.compare_short_labels) if args.compare_short_labels else None
    rows = _sound(reports.judged(cases, rules, _named(args.classifier), args.compare_legacy, short), labels)
    digest = governance.file_sha256(args.dataset)
    facts = {"dataset": args.dataset, "dataset_sha256": digest, "split": args.split, "model": _model(args), "unseen_keywords_validated": apart or args.require_unseen_keywords, "independent_review_readiness": ready}
    report = reports.write_evaluation(rows, rules, args.output_dir, facts)
    print(reports.evaluation_markdown(report))
    if args.export_rule_profile:
        profile = profiles.rule_profile(rules, report["rule_review_validation"], governance.bindings(base, _model(args)), digest)
        governance.write_new_json(_new(args.export_rule_profile, False, args.dataset), profile)
    return 0


def _predicted(args: argparse.Namespace, cases: DataFrame, rules: RuleSet) -> DataFrame:
    return _sound(reports.judged(cases, rules, _named(args.classifier)), list(rules.labels))


def _require_rules(rules: RuleSet, rows: DataFrame, baseline: str) -> None:
    """Development terms must rest on these rows and mend errors of the baseline's."""
    if any(t.origin == "development" for t in rules.terms):
        governance.require_none(governance.evidence_problems(rules, rows), "rule evidence")
        governance.require_none(governance.errors_without_support(rules, rows.withColumn("baseline", F.col(baseline))), "rules that mend no error")


def calibrate_confidence(args: argparse.Namespace) -> int:
    out, rules, spark = _new(args.output, args.force, args.dataset), _rules(args), session()
    ship(spark)
    cases = governance.require_cases(_articles(spark, args.dataset), "development", list(rules.labels))
    rows = _predicted(args, cases, rules)
    _require_rules(rules, rows, reports.MODEL)
    samples = rows.select(F.col("pred_score").alias("score"), F.col("pred_margin").alias("margin"), (F.col("pred_label") == F.col("gold")).alias("correct"))
    governance.require_none(calibrate.invalid_samples(samples), "invalid score or margin")
    best = calibrate.tiers(samples, args.high_lower_bound, args.medium_lower_bound, args.minimum_support).first()
    if best is None:
        raise governance.Rejected("no thresholds reach the bounds; the present ones stay")
    chosen = {f"{tier}_{x}": best[f"{tier}_{x}"] for tier in ("high", "medium") for x in ("score", "margin")}
    governance.thresholds(chosen)
    evidence = {k: v for k, v in best.asDict().items() if k not in chosen}
    governance.replace_json(out, {"schema_version": 1, "dataset_sha256": governance.file_sha256(args.dataset), "split": "development", "bindings": governance.bindings(rules, _model(args)), "thresholds": chosen, "evidence": evidence})
    print(json.dumps(chosen))
    return 0


def _samples(rows: DataFrame, rules: RuleSet, policy: ruleset.Policy | None = None) -> DataFrame:
    """gold, before, relaxed, score, margin, event_id, keyword; relaxed: under the policy, by default with open gates."""
    open_ = policy or ruleset.replace(rules.policy, ambiguity_score=0.0, ambiguity_margin=0.0, review_model_score=0.0)
    return rows.select(
        "gold", F.col(reports.HYBRID).alias("before"), decide.decision(rules, open_)["final_label"].alias("relaxed"), F.col("pred_score").alias("score"), F.col("pred_margin").alias("margin"), "event_id", "keyword", "pred_label",
    )


def _judge_policy(samples: DataFrame, labels: list[str], least: int, target: float) -> tuple[dict, list[str]]:
    """Evidence of a policy's decisions (relaxed) against the present ones (before), and why it is refused."""
    s = samples.withColumn("after", F.col("relaxed")).withColumn("new", calibrate.newly(F.col("before"), F.col("relaxed")))
    chosen, new = (calibrate.evidence(s, c, labels).first().asDict() for c in ("after", "new"))
    row = calibrate.compare(s, labels).first().asDict() | {f"{p}_{k}": e[k] for p, e in (("selected", chosen), ("new", new)) for k in ("independent_support", "lower_bound")}
    groups = [
        {"kind": kind, "key": r["key"], "new_support": r["new_support"], "new_correct": r["new_correct"]}
        for kind, c in (("label", F.col("gold")), ("keyword", T.normalize_key("keyword", False))) for r in calibrate.compare(s.withColumn("key", c), labels, ["key"]).collect()
    ]
    return chosen, calibrate.failures(row, groups, least, target)


def calibrate_decision(args: argparse.Namespace) -> int:
    calibrate.validate_targets(args.minimum_support, args.accuracy_lower_bound)
    out, rules, spark = _new(args.output, args.force, args.dataset), _rules(args), session()
    ship(spark)
    labels, least, target = list(rules.labels), args.minimum_support, args.accuracy_lower_bound
    df = _articles(spark, args.dataset)
    cases = {s: governance.for_mode(governance.require_cases(df, s, labels, explicit_events=True), args.input_mode) for s in audit.SPLITS}
    governance.require_none(governance.unseen_keywords(cases["development"], cases["evaluation"]), "keywords of both splits")
    rows = _predicted(args, cases["development"], rules)
    _require_rules(rules, rows, reports.BEFORE)
    samples = _samples(rows, rules)
    for name, odd in governance.sample_problems(samples, labels).items():
        governance.require_none(odd, name)
    best = calibrate.best_gate(calibrate.decision_grid(samples, labels, rules.policy, least, target)).first()
    if best is None:
        raise governance.Rejected("no relaxed gate has the evidence; the present policy stays")
    policy = calibrate.gated(rules.policy, best["score"], best["margin"])
    evidence = {}
    for split, judged in (("development", rows), ("evaluation", _predicted(args, cases["evaluation"], rules))):
        evidence[split], why = _judge_policy(_samples(judged, rules, policy), labels, least, target)
        if why:
            raise governance.Rejected(f"{split}: {'; '.join(why)}")
    profile = governance.decision_profile(policy, evidence, governance.bindings(rules, _model(args), args.input_mode))
    governance.replace_json(out, profile | {"dataset_sha256": governance.file_sha256(args.dataset)})
    print(json.dumps({"ambiguity_score": policy.ambiguity_score, "ambiguity_margin": policy.ambiguity_margin}))
    return 0


def collect_evaluation(args: argparse.Namespace) -> int:
    spark = session()
    ship(spark)
    if os.path.exists(args.output) and not args.overwrite:
        raise FileExistsError(f"{args.output} exists")
    pools = []
    for n, keyword in enumerate(dict.fromkeys(V.require_non_blank(q, "query") for q in args.query)):
        source = feeds.LandedFeeds(os.path.join(V.require_non_blank(args.feeds or "", "--feeds"), keyword))
        try:
            rows = source.fetch(spark, keyword, args.per_query)
        except feeds.CollectionError as e:
            logging.warning("%s: %s", keyword, e)
            continue
        place = F.row_number().over(sinks.Window.orderBy("ord")) - 1  # at most 100 rows of a feed
        pools.append(rows.withColumn("place", place).withColumn("query_ord", F.lit(n)).drop("ord"))
    if not pools:
        raise feeds.CollectionError("no query gave an article")
    rows = pools[0]
    for more in pools[1:]:
        rows = rows.unionByName(more)
    rows = rows.withColumn("title", T.strip_source_suffix("title", "source")).withColumn("event_id", V.event_id("title")).where("event_id is not null")
    picked = pipeline.dedup.written(feeds.round_robin(rows, args.per_query, args.target_total))
    if args.pages:
        picked = extract.enriched(picked, spark.read.parquet(args.pages))
    out = picked.select(V.article_id(F.lit(""), F.col("link"), F.col("title"), F.col("source")).alias("id"), "event_id", *feeds.ARTICLE.fieldNames(), "turn", "query_ord").orderBy("turn", "query_ord").drop("turn", "query_ord")
    sinks.write_candidates(out.coalesce(1), args.output, args.overwrite)
    print(f"{picked.count()} candidates: {args.output}")
    return 0


def _labels(args: argparse.Namespace) -> list[str]:
    return list(_rules(args).labels) if args.rules else list(ruleset.LABELS)


def _review_columns(df: DataFrame) -> DataFrame:
    names = ["id", "keyword", "title", "link", "source", "published_at", "description", "content", "gold_label", "event_id", "review_status", "reviewed_by", "split", "suggested_label", "independent_event_check", "main_event", "main_event_evidence"]
    return df.withColumns({c: F.lit("") for c in names if c not in df.columns})


def prepare_review(args: argparse.Namespace) -> int:
    spark = session()
    ship(spark)
    report_path = f"{os.path.splitext(args.output)[0]}.readiness.json"
    for path in (args.output, report_path):
        _new(path, False, *args.dataset, *args.confirmed_json)
    candidates = None
    for n, path in enumerate(args.dataset):
        part = _review_columns(feeds.read_reviewed(spark, path)).withColumn("ord", F.lit(n << 40) + F.monotonically_increasing_id())
        candidates = part if candidates is None else candidates.unionByName(part, allowMissingColumns=True)
    told = []
    for path in args.confirmed_json:
        with open(path, encoding="utf-8-sig") as f:
            p = json.load(f)
        if not isinstance(p, dict) or p.get("dataset_role") != "development" or not isinstance(p.get("cases"), list):
            raise ValueError(f"{path}: a list of cases in the development role is needed")
        told += [{k: "" if v is None else str(v) for k, v in c.items()} for c in p["cases"]]
    names = sorted({k for c in told for k in c} | {"id"})
    confirmed = _review_columns(spark.createDataFrame([tuple(c.get(n, "") for n in names) for c in told], ", ".join(f"`{n}` string" for n in names))).withColumn("ord", F.monotonically_increasing_id())
    rows = pipeline.dedup.written(_review_columns(audit.prepared_review(candidates, confirmed).drop("reference")))
    if rows.isEmpty():
        raise ValueError("no article to review")
    report = reports.readiness_report(rows, _labels(args), args.min_events_per_label)
    report["source_datasets"] = [{"path": x, "sha256": governance.file_sha256(x)} for x in (*args.dataset, *args.confirmed_json)]
    sinks.write_table(rows.orderBy("id"), args.output)
    governance.write_new_json(report_path, report | {"dataset_sha256": governance.file_sha256(args.output)})
    print(f"{report['article_count']} articles: {args.output}")
    return 0


def check_review(args: argparse.Namespace) -> int:
    spark = session()
    ship(spark)
    report = reports.readiness_report(_review_columns(feeds.read_reviewed(spark, args.dataset)), _labels(args), args.min_events_per_label)
    report |= {"dataset": args.dataset, "dataset_sha256": governance.file_sha256(args.dataset)}
    if args.report:
        governance.write_new_json(_new(args.report, False, args.dataset), report)
    print(json.dumps(report, ensure_ascii=False, indent=2))
    return 0 if report["ready"] else 1


def review_candidates(args: argparse.Namespace) -> int:
    rules, spark = _rules(args), session()
    ship(spark)
    out = _new(args.output, False, args.dataset)
    wanted = [profiles.parse_candidate(x, rules) for x in args.candidate]
    df = _review_columns(_articles(spark, args.dataset))
    governance.require_none(governance.development_only(df).select("id"), "only development articles may be mined")
    fields = pipeline.dedup.written(audit.article_fields(df))
    found = pipeline.dedup.written(audit.phrase_evidence(fields, wanted))
    warned = audit.phrase_evidence(fields, [(kind, w) for kind, ws in audit.WARNINGS.items() for w in ws])
    counts = {(r["label"], r["phrase"]): r for r in audit.phrase_counts(found, df).collect()}
    near = audit.context_warnings(found, warned).groupBy("phrase", "kind").agg(F.count_distinct("id").alias("articles")).collect()
    labels = found.join(df.select("id", "gold_label"), "id").where("gold_label <> '' and gold_label <> label").groupBy("label", "phrase", "gold_label").agg(F.count_distinct("id").alias("articles")).collect()
    related = audit.phrase_relations(audit.phrase_table(spark, wanted), audit.phrase_table(spark, audit.rules_as_phrases(rules))).collect()
    report = [
        {
            "category": label, "phrase": phrase, "articles": counts[label, phrase]["articles"] if (label, phrase) in counts else 0,
            "confirmed_rows": counts[label, phrase]["confirmed_rows"] if (label, phrase) in counts else 0, "events": counts[label, phrase]["events"] if (label, phrase) in counts else 0,
            "relations": [{"category": r["other_label"], "phrase": r["other_phrase"], "relation": r["relation"], "conflict": r["other_label"] != label} for r in related if (r["label"], r["phrase"]) == (label, phrase)],
            "other_gold": {r["gold_label"]: r["articles"] for r in labels if (r["label"], r["phrase"]) == (label, phrase)}, "warnings": {r["kind"]: r["articles"] for r in near if r["phrase"] == phrase},
        }
        for label, phrase in wanted
    ]
    governance.write_new_json(out, {"schema_version": 1, "profile_type": "candidate_audit", "dataset_sha256": governance.file_sha256(args.dataset), "candidates": report})
    return 0


def audit_reasons(args: argparse.Namespace) -> int:
    spark = session()
    ship(spark)
    out = _new(args.output, False, *args.input)
    rows = None
    for path in args.input:
        part = sinks.migrated(feeds.read_results(spark, path))
        part = part.select(*[F.col(c).cast("string").alias(c) if c in part.columns else F.lit(None).cast("string").alias(c) for c in feeds.RESULT])
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.withColumn("model_score", F.col("model_category_score"))
    table = audit.review_rollup(rows, _labels(args), args.score_threshold, args.margin_threshold)
    report = {
        "articles": [r.asDict() for r in table.orderBy("level", "keyword", "model_category").collect()], "retries": {r["status"]: r["n"] for r in audit.retry_counts(rows).collect()},
        "scores": reports.probabilities_low(rows, args.score_threshold, args.margin_threshold),
    }
    governance.write_new_json(out, report)
    return 0


def compare_body(args: argparse.Namespace) -> int:
    spark = session()
    out = _new(args.output, False, args.input)
    r = F.from_json("review_reclassification", "status string, initial_final_category string")
    rows = sinks.migrated(feeds.read_results(spark, args.input)).withColumn("r", r)
    told = rows.select(F.coalesce("r.initial_final_category", "final_category").alias("before"), F.col("final_category").alias("after"), (F.coalesce(F.col("r.status"), F.lit("")) == "RECLASSIFIED").alias("reclassified"))
    governance.write_new_json(out, audit.replay(told).first().asDict())
    return 0


def compare_context(args: argparse.Namespace) -> int:
    rules, spark = _rules(args), session()
    ship(spark)
    out = _new(args.output, False, args.dataset)
    cases = governance.require_cases(_articles(spark, args.dataset), "development", list(rules.labels))
    rows = decide.with_anchor(_predicted(args, cases, rules), rules)
    rows = pipeline.dedup.written(rows.select("id", "event_id", "gold", F.col(reports.HYBRID).alias("before"), decide.decision(rules, anchored=F.col("anchored"))["final_label"].alias("after")))
    changed = reports.context_comparison(rows)
    flags = ("harmed", "corrected", "wrong_automatic_to_review")
    counts = changed.agg(F.count(F.lit(1)).alias("changed"), *[F.count_if(c).alias(c) for c in flags]).first().asDict()
    review = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("before") == REVIEW).alias("review_before"), F.count_if(F.col("after") == REVIEW).alias("review_after")).first().asDict()
    governance.write_new_json(out, review | counts | {"cases": [r.asDict() for r in changed.orderBy("id").toLocalIterator()]})
    return 0


def main(argv: Sequence[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        return args.run(args)
    except FAILURES as e:
        print(f"{args.command}: {e}", file=sys.stderr)
        return 1
