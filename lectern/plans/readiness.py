"""What stands in the way of a run: each check is OK, WARN or BLOCKED; ready means that none is BLOCKED."""

from __future__ import annotations

from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import config, course_files
from ..sources.config import ConfigError, Manifest, Pricing, Request, SweepPlan

OK, WARN, BLOCKED = "OK", "WARN", "BLOCKED"


@dataclass(frozen=True)
class Check:
    name: str
    status: str
    detail: str


def ready(checks: list[Check]) -> bool:
    return all(c.status != BLOCKED for c in checks)


def store(root: str) -> Check:
    where, base = course_files.located(root)
    kind = where.get_file_info(base).type
    if kind == fs.FileType.NotFound:
        return Check("store", WARN, f"{root} isn't there yet; the first write makes it")
    return Check("store", OK, root) if kind == fs.FileType.Directory else Check("store", BLOCKED, f"{root} is no folder")


def corpus(spark: SparkSession, root: str) -> list[Check]:
    """PDF files there are, and those whose pages can't be listed."""
    try:
        n, broken = course_files.files(spark, root, suffix=".pdf").agg(F.count(F.lit(1)), F.count("error")).first()
    except Exception as e:
        if "no folder" not in str(e):
            raise
        return [Check("corpus", BLOCKED, f"{root} isn't there")]
    if not n:
        return [Check("corpus", BLOCKED, f"{root} holds no PDF file")]
    out = [Check("corpus", OK, f"{n} PDF files under {root}")]
    return out + [Check("corpus files", WARN, f"{broken} of {n} can't be read and will be left out")] if broken else out


def index(spark: SparkSession, path: str, fingerprint: str | None = None) -> Check:
    """The kept index, and whether it was made of what it would be made of now."""
    try:
        kept = [r.fingerprint for r in spark.read.parquet(path).select("fingerprint").distinct().limit(2).collect()]
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return Check("index", WARN, "not built yet; the first run builds it")
    if fingerprint is not None and kept != [fingerprint]:
        return Check("index", WARN, "made of another corpus; the next run builds it anew")
    return Check("index", OK, path)


def plan(plan_: SweepPlan, models: dict[str, dict], pricing: Pricing, requests: list[Request]) -> list[Check]:
    """Models that the plan names but the catalogue doesn't, models without a price, requests that its approaches can't answer."""
    named = sorted({m for c in plan_.configurations for m in (c.generator, c.judge, c.selector)})
    missing = [m for m in named if m not in models]
    free = [m for m in named if m in models and models[m]["model"] not in pricing.models]
    topical = [r.key for r in requests if not r.competency_mode] if any(c.approach == "two-phase" for c in plan_.configurations) else []
    return [
        Check("models", BLOCKED, f"not in the catalogue: {', '.join(missing)}") if missing else Check("models", OK, ", ".join(named)),
        Check("prices", WARN, f"no price: {', '.join(free)}") if free else Check("prices", OK, f"{len(named)} models priced"),
        Check("requests", BLOCKED, f"two-phase configurations can't answer {', '.join(topical)}") if topical else Check("requests", OK, f"{len(requests)} requests"),
    ]


def courses(requests: list[Request], manifests: dict[str, Manifest], documents: DataFrame) -> list[Check]:
    """Competencies that requests name and no manifest declares, and linked documents that the corpus doesn't have.
    ``documents(document_id)``; of them only the linked ones come here."""
    gone = [f"{r.course_key}/{k}" for r in requests for k in r.competency_keys if r.course_key not in manifests or not manifests[r.course_key].by_key(k)]
    linked = sorted({x.document for m in manifests.values() for c in m.competencies for x in (*c.lecture_units, *c.exercises)})
    found = {r.document_id for r in documents.where(F.col("document_id").isin(linked)).select("document_id").distinct().collect()} if linked else set()
    lost = [d for d in linked if d not in found]
    return [
        Check("competencies", BLOCKED, f"not declared: {', '.join(sorted(set(gone)))}") if gone else Check("competencies", OK, f"{len(manifests)} courses"),
        Check("links", WARN, f"{len(lost)} linked documents aren't in the corpus: {', '.join(lost[:5])}") if lost else Check("links", OK, f"{len(linked)} linked documents"),
    ]


def parsed(spark: SparkSession, paths: dict[str, str | None]) -> tuple[list[Check], dict]:
    """Configuration files by kind (``requests``, ``manifest``, ``pricing``, ``models``, ``sweep``): a check each, and what they hold."""
    readers = {"requests": config.requests, "manifest": config.manifest, "pricing": config.pricing, "models": config.models, "sweep": config.sweep_plan}
    checks, held = [], {}
    for name, read in readers.items():
        if not (path := paths.get(name)):
            checks.append(Check(name, WARN, "not given"))
            continue
        try:
            held[name] = read(config.read_text(spark, path))
            checks.append(Check(name, OK, path))
        except Exception as e:  # whatever is wrong with a file is what is told
            checks.append(Check(name, BLOCKED, str(e) if isinstance(e, ConfigError) else f"{type(e).__name__}: {e}"))
    return checks, held
