"""Configuration files: YAML and JSON read on the driver, checked by hand, returned as records or small DataFrames.

Every error names the file's part it is about. Unknown fields are errors in requests, and ignored where a default exists.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..schemas import DIFFICULTIES, LANGUAGES, QUESTION_TYPES, RELATIONS, TAXONOMIES

MOST_QUESTIONS, LONGEST_PROMPT = 20, 2000
APPROACHES = ("agentic", "two-phase")


class ConfigError(ValueError):
    """A configuration that can't be used."""


def read_text(spark: SparkSession, path: str) -> str:
    """A small file through Spark's file systems."""
    rows = spark.read.text(path, wholetext=True).collect()
    if len(rows) != 1:
        raise ConfigError(f"{path}: expected one file")
    return rows[0].value


def parse_yaml(text: str):
    import yaml

    return yaml.safe_load(text)


def _need(entry: dict, name: str, where: str):
    value = entry.get(name)
    if value is None or value == "":
        raise ConfigError(f"{where}: {name!r} is missing")
    return value


def _one_of(value, allowed, where: str):
    if value not in allowed:
        raise ConfigError(f"{where}: {value!r} is none of {', '.join(map(str, allowed))}")
    return value


def _positive(value, where: str) -> int:
    if not isinstance(value, int) or isinstance(value, bool) or value < 1:
        raise ConfigError(f"{where}: a whole number of 1 or more is needed, not {value!r}")
    return value


def _unique(keys: list[str], what: str) -> None:
    twice = sorted({k for k in keys if keys.count(k) > 1})
    if twice:
        raise ConfigError(f"{what} named twice: {', '.join(twice)}")


@dataclass(frozen=True)
class Request:
    key: str
    course_key: str
    language: str
    question_types: tuple[str, ...]
    number_of_questions: int
    difficulty: str
    topic: str | None = None
    competency_keys: tuple[str, ...] = ()
    optional_prompt: str | None = None

    @property
    def competency_mode(self) -> bool:
        return bool(self.competency_keys)


REQUEST_FIELDS = {"key", "course", "topic", "competencies", "prompt", "language", "question-types", "number-of-questions", "difficulty"}


def requests(text: str) -> list[Request]:
    """The request list: unique keys, a topic or competencies but not both, 1 to 20 questions, prompts of 2000 characters."""
    entries = parse_yaml(text)
    if not isinstance(entries, list) or not entries:
        raise ConfigError("a list of requests is needed")
    out = []
    for i, e in enumerate(entries):
        where = f"request {i} ({e.get('key') if isinstance(e, dict) else e!r})"
        if not isinstance(e, dict):
            raise ConfigError(f"{where}: not a mapping")
        if unknown := sorted(set(e) - REQUEST_FIELDS):
            raise ConfigError(f"{where}: unknown field {', '.join(unknown)}")
        topic, keys = e.get("topic"), tuple(e.get("competencies") or ())
        if bool(topic) == bool(keys):
            raise ConfigError(f"{where}: exactly one of topic and competencies is needed")
        types = tuple(_one_of(x, QUESTION_TYPES, where) for x in e.get("question-types") or ())
        if not types:
            raise ConfigError(f"{where}: at least one question type is needed")
        n = _positive(_need(e, "number-of-questions", where), where)
        if n > MOST_QUESTIONS:
            raise ConfigError(f"{where}: {n} questions are more than {MOST_QUESTIONS}")
        prompt = e.get("prompt")
        if prompt and len(prompt) > LONGEST_PROMPT:
            raise ConfigError(f"{where}: the prompt is longer than {LONGEST_PROMPT}")
        out.append(Request(_need(e, "key", where), _need(e, "course", where), _one_of(_need(e, "language", where), LANGUAGES, where), types, n, _one_of(_need(e, "difficulty", where), DIFFICULTIES, where), topic, keys, prompt))
    _unique([r.key for r in out], "request")
    return out


@dataclass(frozen=True)
class Link:
    document: str
    weight: float = 1.0


@dataclass(frozen=True)
class Relation:
    type: str
    target: str


@dataclass(frozen=True)
class Competency:
    key: str
    title: str
    description: str | None = None
    taxonomy: str = "UNDERSTAND"
    query: str | None = None
    optional: bool = False
    lecture_units: tuple[Link, ...] = ()
    exercises: tuple[Link, ...] = ()
    relations: tuple[Relation, ...] = ()

    @property
    def documents(self) -> list[str]:
        return [x.document for x in (*self.lecture_units, *self.exercises)]

    @property
    def retrieval_query(self) -> str:
        if self.query and self.query.strip():
            return self.query
        if not self.description or not self.description.strip():
            return self.title
        return f"{self.title}. {self.description.replace(chr(10), ' ').replace('- ', '')}"


@dataclass(frozen=True)
class Manifest:
    course_key: str
    title: str
    competencies: tuple[Competency, ...]

    def by_key(self, key: str) -> Competency | None:
        return next((c for c in self.competencies if c.key == key), None)

    def frames(self, spark: SparkSession) -> dict[str, DataFrame]:
        """``competency``, ``link`` and ``relation`` as small DataFrames."""
        c = [(self.course_key, i, x.key, x.title, x.description, x.taxonomy, x.retrieval_query) for i, x in enumerate(self.competencies)]
        links = [(self.course_key, x.key, kind, y.document, y.weight) for x in self.competencies for kind, ys in (("unit", x.lecture_units), ("exercise", x.exercises)) for y in ys]
        rel = [(self.course_key, x.key, y.type, y.target) for x in self.competencies for y in x.relations]
        return {
            "competency": spark.createDataFrame(c, "course_key string, ord int, competency_key string, title string, description string, taxonomy string, query string"),
            "link": spark.createDataFrame(links, "course_key string, competency_key string, kind string, document_id string, weight double"),
            "relation": spark.createDataFrame(rel, "course_key string, competency_key string, type string, target string"),
        }


def manifest(text: str) -> Manifest:
    """A competency manifest: unique keys, known taxonomies and relation types, relations to declared competencies."""
    root = parse_yaml(text) or {}
    course = root.get("course") or {}
    out = []
    for i, e in enumerate(root.get("competencies") or ()):
        where = f"competency {i} ({e.get('key')})"
        links = lambda name: tuple(Link(_need(x, "document", where), float(x.get("weight", 1.0))) for x in e.get(name) or ())  # noqa: B023, E731
        rel = tuple(Relation(_one_of(_need(x, "type", where), RELATIONS, where), _need(x, "target", where)) for x in e.get("relations") or ())
        out.append(Competency(_need(e, "key", where), _need(e, "title", where), e.get("description"), _one_of(e.get("taxonomy", "UNDERSTAND"), TAXONOMIES, where), e.get("query"), bool(e.get("optional", False)), links("lectureUnits"), links("exercises"), rel))
    if not out:
        raise ConfigError("the manifest declares no competency")
    _unique([c.key for c in out], "competency")
    known = {c.key for c in out}
    for c in out:
        for r in c.relations:
            if r.target not in known:
                raise ConfigError(f"competency {c.key}: relation to undeclared {r.target!r}")
    return Manifest(_need(course, "key", "course"), course.get("title", ""), tuple(out))


def slug(title: str) -> str:
    return re.sub(r"-+", "-", "".join(x if x.isalnum() else "-" for x in title.lower())).strip("-")


def catalogue(text: str, course_key: str = "") -> Manifest:
    """A competency catalogue in JSON: keys are slugs of the titles, bullets become lines, there are no links."""
    out = []
    for e in json.loads(text):
        title = _need(e, "title", "catalogue entry")
        key = slug(title)
        if not key:
            raise ConfigError(f"title {title!r} yields an empty key")
        bullets = e.get("description") or []
        out.append(Competency(key, title, "\n".join(map(str, bullets)) if isinstance(bullets, list) else str(bullets), _one_of(e.get("taxonomy", "UNDERSTAND"), TAXONOMIES, key)))
    _unique([c.key for c in out], "competency")
    return Manifest(course_key, "", tuple(out))


@dataclass(frozen=True)
class Configuration:
    id: str
    approach: str
    generator: str
    judge: str
    selector: str

    @property
    def configuration_id(self) -> str:
        return "|".join((self.approach, self.generator, self.judge, self.selector))


@dataclass(frozen=True)
class SweepPlan:
    sweep: str
    requests_file: str
    configurations: tuple[Configuration, ...]
    repetitions: int = 3
    items_per_cell: int = 20
    generation_batch_size: int = 12
    retrieval_top_m: int = 40
    languages: tuple[str, ...] = LANGUAGES
    question_types: tuple[str, ...] = QUESTION_TYPES
    difficulties: tuple[str, ...] = tuple(DIFFICULTIES)
    max_candidates: int = 40
    temperature: float = 1.0
    max_attempts: int = 3
    top_up_rounds: int = 3
    max_rounds: int = 5


def sweep_plan(text: str) -> SweepPlan:
    """An experiment: which configurations answer which requests, how often. Sections and their fields have defaults; a
    configuration without a selector selects with its judge."""
    e = parse_yaml(text) or {}
    pool, selection, agentic = e.get("pool") or {}, e.get("selection") or {}, e.get("agentic") or {}
    out = []
    for i, c in enumerate(e.get("configurations") or ()):
        where = f"configuration {i} ({c.get('id')})"
        judge = _need(c, "judge", where)
        out.append(Configuration(_need(c, "id", where), _one_of(_need(c, "approach", where), APPROACHES, where), _need(c, "generator", where), judge, c.get("selector") or judge))
    if not out:
        raise ConfigError("the sweep names no configuration")
    _unique([c.id for c in out], "configuration")
    _unique([c.configuration_id for c in out], "configuration")
    d = SweepPlan("", "", ())
    n = lambda section, name, default: _positive(section.get(name, default), name)
    return SweepPlan(
        _need(e, "sweep", "sweep"), _need(e, "requests-file", "sweep"), tuple(out), n(e, "repetitions", d.repetitions), n(pool, "items-per-cell", d.items_per_cell),
        n(pool, "generation-batch-size", d.generation_batch_size), n(pool, "retrieval-top-m", d.retrieval_top_m), tuple(_one_of(x, LANGUAGES, "pool") for x in pool.get("languages", d.languages)),
        tuple(_one_of(x, QUESTION_TYPES, "pool") for x in pool.get("question-types", d.question_types)), tuple(_one_of(x, DIFFICULTIES, "pool") for x in pool.get("difficulties", d.difficulties)),
        n(selection, "max-candidates", d.max_candidates), float(selection.get("temperature", d.temperature)), n(selection, "max-attempts", d.max_attempts), int(selection.get("top-up-rounds", d.top_up_rounds)),
        n(agentic, "max-rounds", d.max_rounds),
    )


@dataclass(frozen=True)
class RunPlan:
    plan: str
    items_per_topic: int
    configurations: tuple[tuple[str, str, str], ...]
    topics: tuple[str, ...] = ()


def run_plan(text: str) -> RunPlan:
    e = parse_yaml(text) or {}
    cs = tuple((_need(c, "id", "configuration"), _need(c, "generator", "configuration"), _need(c, "filter", "configuration")) for c in e.get("configurations") or ())
    if not cs:
        raise ConfigError("the plan names no configuration")
    _unique([c[0] for c in cs], "configuration")
    return RunPlan(_need(e, "plan", "plan"), _positive(_need(e, "items-per-topic", "plan"), "items-per-topic"), cs, tuple(e.get("topics") or ()))


def file_slug(value: str | None) -> str:
    return re.sub(r"^-+|-+$", "", re.sub(r"[^a-z0-9]+", "-", (value or "").lower()))


def write_run_plan(name: str, generators: list[str], filters: list[str], items_per_topic: int, existing: set[str]) -> tuple[str, str]:
    """File name and text of a plan of all generators with all filters; it must read back, and must not be there yet."""
    import yaml

    plan = file_slug(name)
    if not plan:
        raise ConfigError(f"{name!r} yields no plan name")
    if f"{plan}.yml" in existing:
        raise ConfigError(f"plan {plan!r} exists")
    cells = [{"id": f"{file_slug(g)}-gen-{file_slug(f)}-filter", "generator": g, "filter": f} for g in generators for f in filters]
    text = yaml.safe_dump({"plan": plan, "items-per-topic": items_per_topic, "topics": [], "configurations": cells}, sort_keys=False)
    run_plan(text)
    return f"{plan}.yml", text


def models(text: str) -> dict[str, dict]:
    """Model catalogue: every model names a declared backend."""
    e = parse_yaml(text) or {}
    backends, out = e.get("backends") or {}, e.get("models") or {}
    for key, m in out.items():
        if (b := _need(m, "backend", f"model {key}")) not in backends:
            raise ConfigError(f"model {key}: backend {b!r} isn't declared")
    return {k: {"model": m.get("model", k), "backend": m["backend"], "base_url": backends[m["backend"]].get("base-url")} for k, m in out.items()}


@dataclass(frozen=True)
class Pricing:
    models: dict[str, tuple[str, float, float]] = field(default_factory=dict)
    gpu_low: float = 0.0
    gpu_high: float = 0.0

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(m, *p) for m, p in self.models.items()], "model string, billing string, input_eur double, output_eur double")


def pricing(text: str) -> Pricing:
    """Prices: by GPU time, or by tokens with both prices; GPU rates default to none."""
    e = parse_yaml(text) or {}
    out = {}
    for name, p in (e.get("models") or {}).items():
        billing = _one_of(_need(p, "billing", f"price of {name}"), ("gpu-time", "tokens"), f"price of {name}")
        prices = [float(_need(p, f, f"price of {name}")) for f in ("input-eur-per-million", "output-eur-per-million")] if billing == "tokens" else [0.0, 0.0]
        out[name] = (billing, *prices)
    gpu = e.get("gpu") or {}
    return Pricing(out, float(gpu.get("electricity-eur-per-hour", 0)), float(gpu.get("rental-eur-per-hour", 0)))


def topic_lines(text: str) -> list[str]:
    """Topics of a text file: one a line, blank lines and comments left out."""
    return [x for line in text.splitlines() if (x := line.strip()) and not x.startswith("#")]


def request_builder(manifest_: Manifest, language: str, types: tuple[str, ...], n: int, difficulty: str) -> list[Request]:
    """A request for each competency of a manifest."""
    return [Request(f"{manifest_.course_key}-{c.key}", manifest_.course_key, language, types, n, difficulty, None, (c.key,)) for c in manifest_.competencies]


def match_competency(declared: str | None, request: Request, manifest_: Manifest) -> str | None:
    """The requested competency that a question declares: key or title, whatever the case, a closing bracket left out. A
    request for one competency needs no match."""
    if len(request.competency_keys) == 1:
        return request.competency_keys[0]
    plain = re.sub(r"\s*\([^()]*\)$", "", (declared or "").strip().lower()).strip()
    if not plain:
        return None
    for key in request.competency_keys:
        c = manifest_.by_key(key)
        if plain in (key.lower(), c.title.lower().strip() if c else key.lower()):
            return key
    return None


def safe_name(name: str) -> bool:
    """A run's name can be a folder's."""
    return bool(re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", name or ""))


def safe_path(name: str) -> str:
    """A relative path that stays in its folder, in composed form."""
    import unicodedata

    plain = unicodedata.normalize("NFC", name.replace("\\", "/"))
    parts = [p for p in plain.split("/") if p not in ("", ".")]
    if not parts or ".." in parts or plain.startswith("/") or ":" in plain:
        raise ConfigError(f"{name!r} leaves its folder")
    return "/".join(parts)


# What an upload may hold.
UPLOAD_KINDS, UPLOAD_FILE, UPLOAD_TOTAL, UPLOAD_ENTRIES = (".pdf", ".zip"), 200 << 20, 2 << 30, 5000


def staged(files: list[tuple[str, int]], inside: str | None = None) -> list[str]:
    """The places below the corpus that uploaded files ``(name, bytes)``, or those of the archive ``inside``, are put to. An error if
    a name leaves its folder, a file is of another kind or too large, or together they are too many or too large. Of an
    archive's entries only PDF files are taken."""
    if inside is not None and len(files) > UPLOAD_ENTRIES:
        raise ConfigError(f"{inside}: {len(files)} entries are more than {UPLOAD_ENTRIES}")
    out, total = [], 0
    for name, size in files:
        place = safe_path(name)
        kind = "." + place.rsplit(".", 1)[-1].lower()
        if inside is not None and kind != ".pdf":
            continue
        if kind not in UPLOAD_KINDS:
            raise ConfigError(f"{name}: only {' and '.join(UPLOAD_KINDS)} files are taken")
        total += size
        if size > UPLOAD_FILE:
            raise ConfigError(f"{name}: {size} bytes are more than {UPLOAD_FILE}")
        if total > UPLOAD_TOTAL:
            raise ConfigError(f"together the files are larger than {UPLOAD_TOTAL} bytes")
        out.append(place)
    return out


def mapping_problems(course: str, manifest_: Manifest, decks: dict[str, str], links: dict[str, list[str]], present: set[str]) -> list[str]:
    """What is wrong with a hand-made mapping: unknown competencies, links to decks that aren't declared, decks without a file,
    files without a deck, and folders of several decks."""
    known, out = {c.key for c in manifest_.competencies}, []
    for key, documents in links.items():
        if key not in known:
            out.append(f"{course}: {key!r} matches no competency")
        out += [f"{course}: {key!r} links {d!r}, which is no deck" for d in documents if d not in decks]
    out += [f"{course}: file {d!r} has no deck" for d in sorted(present - set(decks))]
    out += [f"{course}: deck {d!r} has no file" for d in sorted(set(decks) - present)]
    folders: dict[str, list[str]] = {}
    for d, folder in decks.items():
        folders.setdefault(folder, []).append(d)
    return out + [f"{course}: folder {f!r} holds {len(ds)} decks" for f, ds in sorted(folders.items()) if len(ds) > 1]


def manifest_of(course_key: str, catalogue_: Manifest, decks: dict[str, str], links: dict[str, list[str]]) -> Manifest:
    """A catalogue's competencies with the documents that a mapping links them to, as ``folder/deck``."""
    from dataclasses import replace

    cs = tuple(replace(c, lecture_units=tuple(Link(f"{decks[d]}/{d}") for d in links.get(c.key, ()))) for c in catalogue_.competencies)
    return Manifest(course_key, catalogue_.title, cs)


def split_requests(requests_: list[Request]) -> list[Request]:
    """One request for each competency of each request, keyed ``<request>-<competency>``."""
    from dataclasses import replace

    return [replace(r, key=f"{r.key}-{k}", competency_keys=(k,)) for r in requests_ for k in r.competency_keys]
