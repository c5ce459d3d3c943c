"""Context packs: what a role may see of the hits for a task, as Markdown."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import vocabulary as v
from ..config import EngineConfig, PackRequest
from ..functions import text as T
from . import recall as R


@dataclass(frozen=True)
class Role:
    name: str
    framing: str
    cold: bool
    cold_reason: str
    verification: tuple[str, ...]
    next_action: str
    exclusions: tuple[str, ...]


ROLES: dict[str, Role] = {
    r.name: r
    for r in (
        Role(
            "orchestration", "Plan the work and hand out its parts. What is curated below is all you plan from; the corpus itself stays closed.", False, "left out: plans rest on curated memory.",
            ("Each part handed out names the artifact, or the stated assumption, that it rests on.", "Say which aims nothing below supports."),
            "Plan who does what for: {task}. Name the artifacts behind each step; mark steps that first need cold evidence.",
            ("The raw corpus and transcripts: too detailed for planning.", "Cold originals: ask for a verification pack where proof is needed."),
        ),
        Role(
            "execution", "Do one task with what this pack holds. If that isn't enough, say what is missing; don't guess and don't search the corpus.", False, "left out: the task is done from the curated part.",
            ("All that you claim comes from an artifact listed here.", "Stop and ask where a fact is missing; never make one up."),
            "Do this: {task}. Use the artifacts listed here only, and report gaps that stop you.",
            ("The raw corpus, transcripts and cold originals.", "Whatever isn't listed as an artifact here."),
        ),
        Role(
            "verification", "Hold claims against their evidence. The originals are here because checking is a good reason to open them.", True, "included: claims are checked against originals.",
            ("Compare artifacts with originals by sha256, whatever the files are called.", "List claims without support or against the evidence, with the hash of their source.", "Where an artifact and its original differ, the original is right."),
            "Check: {task}. For each claim give the sha256 of the original that settles it, and pass or fail.",
            ("All but the cited sources.",),
        ),
        Role(
            "research", "Look into an open question. Begin with curated memory; originals are here as it may not say everything.", True, "included: an answer may lie outside curated memory.",
            ("Keep what the material says apart from what you conclude.", "Give the sha256 of sources that have one, and name what is missing."),
            "Find out: {task}. Bring the curated and the cold material together with its sources, and end with what stays unknown.",
            ("Guesses that are told as facts.",),
        ),
        Role(
            "synthesis", "Write a dense summary from curated claims, each with its source, and nothing that isn't in them.", False, "left out: summaries rest on promoted claims; ask for a verification pack for word-for-word proof.",
            ("Each statement leads back to an artifact listed here.", "Missing or conflicting evidence is listed as a gap.", "Nothing that admissibility has shut out is cited."),
            "Write the summary of: {task}. Cite artifacts where you use them; close with open gaps.",
            ("Cold originals, unless a verification pack is asked for.", "Claims that no listed artifact makes."),
        ),
        Role(
            "handoff", "Take over work in progress. This pack is its state; go on from here without reading the corpus again.", False, "left out: the state is curated; ask for originals if you need them.",
            ("Work out where things stand from the artifacts before doing anything.", "Bring up what is unclear in the state; don't assume."),
            "Go on with: {task}. Name your next three actions and the questions you have.",
            ("Context that listed artifacts have replaced.",),
        ),
    )
}


def role(name: str) -> Role:
    if name not in ROLES:
        raise ValueError(f"no such role: {name!r}; there are {', '.join(ROLES)}")
    return ROLES[name]


def roles(spark: SparkSession) -> DataFrame:
    """The six roles as a table."""
    return spark.createDataFrame([(r.name, r.framing, r.cold, r.cold_reason, list(r.verification), r.next_action, list(r.exclusions)) for r in ROLES.values()], "role string, framing string, include_cold boolean, cold_reason string, verification array<string>, next_action string, exclusions array<string>")


def admitted(hits: DataFrame, most: str = "internal") -> DataFrame:
    """``hits`` (path, admissibility) with level, admitted and, for those shut out, the sentence that says so. Hits without a level are internal, odd ones proprietary."""
    top = most.strip().lower() if most.strip().lower() in T.LEVELS else "internal"
    rows = hits.withColumn("level", T.level(F.col("admissibility")))
    ok = T.level_rank(F.col("level")) <= T.LEVELS.index(top)
    return rows.withColumns({"admitted": ok, "exclusion": F.when(~ok, F.concat(F.lit(v.EXCLUDED[0]), F.coalesce("path", F.lit("?")), F.lit(v.EXCLUDED[1]), "level", F.lit(f"{v.EXCLUDED[2]}{top}.")))})


def within_caps(hits: DataFrame, hot: int, cold: int) -> DataFrame:
    """The first ``hot`` and ``cold`` admitted hits of each tier, in order."""
    # The limit of the window holds before its shuffle as well, so a tier of many hits is no large group.
    ranked = hits.where("admitted").withColumn("n", F.row_number().over(Window.partitionBy("tier").orderBy("place"))).where(F.col("n") <= max(hot, cold, 1))
    return ranked.where(((F.col("tier") == "hot") & (F.col("n") <= hot)) | ((F.col("tier") == "cold") & (F.col("n") <= cold))).drop("n")


_HIT = "path string, score double, sha256 string, admissibility string, tier string, place int"


def _hits(spark: SparkSession, results: dict) -> DataFrame:
    rows = [(h.get("path", "?"), None if h.get("score") is None else float(h["score"]), h.get("sha256"), None if h.get("admissibility") is None else str(h["admissibility"]), t, i) for t in ("hot", "cold") for i, h in enumerate(results.get(t) or [])]
    return spark.createDataFrame(rows, _HIT)


def _line(h) -> str:
    score = "" if h["score"] is None else f" — score {h['score']:.3f}"
    sha = f" — sha256 `{h['sha256'][:16]}…`" if h["sha256"] else ""
    return f"- `{h['path']}`{score}{sha}"


def render(*, project: str, role_name: str, task: str, objective: str, hot: Sequence, cold: Sequence, exclusions: Sequence[str], assumptions: Sequence[str], risks: Sequence[str], weak_hot: bool = False) -> str:
    """The pack's Markdown, from a few capped hits."""
    spec = role(role_name)
    bullets = lambda xs: "\n".join(f"- {x}" for x in xs) or "_(none)_"
    cold_part = ("\n".join(map(_line, cold)) or "_Nothing cold was found._") if spec.cold else f"_Omitted: {spec.cold_reason}_"
    risks = [*risks, *(["Hot recall was weak (its best score is below the floor), so the artifacts above may have little to do with the task."] if weak_hot else [])]
    parts = {
        "Objective": objective or "_(see the task)_", "Role": spec.framing, "Task": task,
        f"Included hot artifacts ({len(hot)})": "\n".join(map(_line, hot)) or "_No hot artifact was found._",
        f"Cold evidence ({len(cold)})" if spec.cold else "Cold evidence": cold_part,
        "Exclusions": bullets(exclusions), "Assumptions": bullets(assumptions), "Risks": bullets(risks),
        "Verification requirements": bullets(spec.verification), "Next action": spec.next_action.format(task=task, project=project),
    }
    head = f"# Context Pack — {project} / {role_name}\n\n> A view of governed memory for one role. Sources are identified by sha256; paths are hints. Leave the raw corpus closed unless this pack says otherwise.\n"
    return "\n".join([head, *(f"## {k}\n\n{x}\n" for k, x in parts.items())]).rstrip() + "\n"


def compile_pack(spark: SparkSession, request: PackRequest, *, config: EngineConfig | None = None, runner: R.Runner | None = None, results: dict | None = None, hits: DataFrame | None = None, weak_hot: bool | None = None) -> str:
    """The pack for ``request`` from given ``results`` (hot, cold, weak_hot), from a table of ``hits`` (as ``recall.two_tiers`` gives), or from the backend.

    Filters and caps run on the executors; what is collected is capped, but for the sentences about hits that were shut out.
    """
    spec, cfg = role(request.role), config or EngineConfig()
    if hits is None:
        results = R.recall(spark, request.task, cfg.recall, runner) if results is None else results
        hits = _hits(spark, results)
        weak_hot = bool(results.get("weak_hot", False))
    for name, kind in (("sha256", "string"), ("admissibility", "string")):
        if name not in hits.columns:
            hits = hits.withColumn(name, F.lit(None).cast(kind))
    judged = admitted(hits, request.max_admissibility)
    shown = [r.asDict() for r in within_caps(judged, request.max_hot, request.max_cold if spec.cold else 0).orderBy("place").collect()]
    tiers = ("hot", "cold") if spec.cold else ("hot",)
    shut = [r["exclusion"] for t in tiers for r in judged.where((F.col("tier") == t) & ~F.col("admitted")).orderBy("place").select("exclusion").collect()]
    return render(
        project=request.project, role_name=request.role, task=request.task, objective=request.objective or f"Give whoever has the {request.role} role what the task needs, from governed memory.",
        hot=[h for h in shown if h["tier"] == "hot"], cold=[h for h in shown if h["tier"] == "cold"], exclusions=[*spec.exclusions, *request.exclusions, *shut],
        assumptions=request.assumptions, risks=request.risks, weak_hot=bool(weak_hot),
    )
