"""Validation of nested records against the bundle contract.

The contract is data: a tree of shapes, and rules that look across fields.  A
record is parsed strictly, walked once, and every broken rule becomes a row
`code, path, message`; nothing is raised.  Records are independent of one
another, so validation is one pass without a shuffle.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.jcs import NotCanonical, canonical_atoms, content_id, parse_strict

VERSION = "1.0.0"

# Closed vocabularies and id forms of the contract (fixed values).
ENUMS = {
    "mode": "demo live",
    "run_status": "completed partial failed",
    "visual": "Supported Contradicted Unobservable",
    "fact": "Supported Contradicted InsufficientEvidence",
    "role": "actor action object attribute location time quantity relation cause",
    "kind": "fact_check news official web image_provenance local_corpus user_supplied",
    "content": "full excerpt_only snippet_only unavailable",
    "match": "exact near_duplicate semantic",
    "stance": "Supports Contradicts NotRelevant Unclear",
    "target": "claim_text image ocr_text",
    "modality": "image text",
    "task": "ai_generation_detection",
    "signal_status": "ok inconclusive unsupported unavailable failed",
    "assessment": "likely_ai_generated likely_human_or_camera uncertain not_assessed",
    "score_calibration": "unknown provider_claimed locally_validated not_applicable",
    "calibration": "calibrated uncalibrated demo_only",
    "provider_status": "ok disabled unconfigured rate_limited failed unsupported",
    "inference": "trained heuristic fixture unavailable",
    "capability": "local_corpus_search web_search fact_check_search content_fetch image_provenance image_ai_detection text_ai_detection dense_retrieval reranking",
}
FORMS = {
    "uuid": r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}",
    "atom": r"a\d{6}",
    "evidence": r"ev_[0-9a-f]{32}_\d{6}",
    "signal": r"fs_[0-9a-f]{32}_\d{6}",
    "region": r"rg_[0-9a-f]{32}_\d{6}",
    "atom_set": r"aset_[0-9a-f]{64}",
    "asset": r"asset_[0-9a-f]{64}",
}
_HEX = re.compile(r"[0-9a-f]{64}")
_TAG = re.compile(r"[A-Za-z]{2,8}(-[A-Za-z0-9]{1,8})*")
_TIME = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)")


@dataclass
class Report:
    found: list[tuple[str, str, str]] = field(default_factory=list)

    def __call__(self, code: str, path: str, message: str = "") -> None:
        self.found.append((code, path, message))


Shape = Callable[[object, str, Report], None]


def _number(v: object) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def _text(v: object, at: str, say: Report, empty: bool = True) -> bool:
    if not isinstance(v, str):
        say("TYPE_MISMATCH", at, "a string is expected")
    elif not v and not empty:
        say("EMPTY_STRING", at)
    else:
        return True
    return False


def text(empty: bool = True, form: str | None = None) -> Shape:
    def check(v: object, at: str, say: Report) -> None:
        if _text(v, at, say, empty) and form and not re.fullmatch(FORMS[form], v):
            say("ID_FORMAT_INVALID", at, form)

    return check


def enum(name: str) -> Shape:
    allowed = set(ENUMS[name].split())

    def check(v: object, at: str, say: Report) -> None:
        if _text(v, at, say) and v not in allowed:
            say("ENUM_INVALID", at, name)

    return check


def real(low: float | None = None, high: float | None = None) -> Shape:
    def check(v: object, at: str, say: Report) -> None:
        if not _number(v):
            say("TYPE_MISMATCH", at, "a number is expected")
        elif not math.isfinite(v):
            say("NON_FINITE_NUMBER", at)
        elif low is not None and not low <= v <= high:
            say("SCORE_OUT_OF_RANGE", at, f"{low} to {high}")

    return check


def whole(least: int = 0) -> Shape:
    def check(v: object, at: str, say: Report) -> None:
        if not isinstance(v, int) or isinstance(v, bool):
            say("TYPE_MISMATCH", at, "an integer is expected")
        elif v < least:
            say("NEGATIVE_VALUE", at, f"at least {least}")

    return check


def flag(v: object, at: str, say: Report) -> None:
    if not isinstance(v, bool):
        say("TYPE_MISMATCH", at, "true or false is expected")


def instant(v: object, at: str, say: Report) -> None:
    if _text(v, at, say, False):
        try:
            ok = bool(_TIME.fullmatch(v)) and datetime.fromisoformat(v.replace("Z", "+00:00")) is not None
        except ValueError:
            ok = False
        if not ok:
            say("TIMESTAMP_INVALID", at, "RFC 3339 with an offset")


def tag(v: object, at: str, say: Report) -> None:
    if _text(v, at, say, False) and not _TAG.fullmatch(v):
        say("LANGUAGE_TAG_INVALID", at)


def digest(v: object, at: str, say: Report) -> None:
    if not isinstance(v, str) or not _HEX.fullmatch(v):
        say("HASH_FORMAT_INVALID", at, "64 lower-case hex digits")


def box(v: object, at: str, say: Report) -> None:
    ok = isinstance(v, list) and len(v) == 4 and all(_number(x) and math.isfinite(x) and 0 <= x <= 1 for x in v)
    if not ok or not (v[0] < v[2] and v[1] < v[3]):
        say("BBOX_INVALID", at, "four numbers, 0 <= min < max <= 1")


def probabilities(labels: str) -> Shape:
    want = set(ENUMS[labels].split())

    def check(v: object, at: str, say: Report) -> None:
        if not isinstance(v, dict):
            say("TYPE_MISMATCH", at, "an object is expected")
            return
        if set(v) != want:
            say("PROBABILITIES_INCOMPLETE", at, "exactly one value per label")
        total = 0.0
        for k, x in v.items():
            real()(x, f"{at}.{k}", say)
            if _number(x):
                total += x
                if x < 0:
                    say("NEGATIVE_VALUE", f"{at}.{k}")
        if set(v) == want and abs(total - 1) > 1e-6:
            say("PROBABILITIES_NOT_NORMALIZED", at, f"{total}")

    return check


def opt(shape: Shape) -> Shape:
    return lambda v, at, say: None if v is None else shape(v, at, say)


def many(shape: Shape) -> Shape:
    def check(v: object, at: str, say: Report) -> None:
        if not isinstance(v, list):
            say("TYPE_MISMATCH", at, "an array is expected")
        else:
            for i, x in enumerate(v):
                shape(x, f"{at}[{i}]", say)

    return check


def mapping(shape: Shape) -> Shape:
    def check(v: object, at: str, say: Report) -> None:
        if not isinstance(v, dict):
            say("TYPE_MISMATCH", at, "an object is expected")
        else:
            for k, x in v.items():
                shape(x, f"{at}.{k}", say)

    return check


def record(fields: dict[str, Shape], *rules: Callable[[dict, str, Report], None], free: bool = False) -> Shape:
    def check(v: object, at: str, say: Report) -> None:
        if not isinstance(v, dict):
            say("TYPE_MISMATCH", at, "an object is expected")
            return
        for k in fields.keys() - v.keys():
            say("FIELD_MISSING", f"{at}.{k}")
        for k in () if free else v.keys() - fields.keys():
            say("UNKNOWN_FIELD", f"{at}.{k}")
        for k in fields.keys() & v.keys():
            fields[k](v[k], f"{at}.{k}", say)
        for rule in rules:
            rule(v, at, say)

    return check


def _dig(v: object, *path: str) -> object:
    for p in path:
        v = v.get(p) if isinstance(v, dict) else None
    return v


def _items(v: object, *path: str) -> list:
    found = _dig(v, *path) if path else v
    return [x for x in found if isinstance(x, dict)] if isinstance(found, list) else []


# --- rules that look across the fields of one record -------------------------


def _media_id(v: dict, at: str, say: Report) -> None:
    if isinstance(v.get("sha256"), str) and v.get("asset_id") != "asset_" + v["sha256"]:
        say("ASSET_ID_MISMATCH", f"{at}.asset_id")


def _span(v: dict, at: str, say: Report) -> None:
    if isinstance(v.get("start"), int) and isinstance(v.get("end"), int) and not v["start"] < v["end"]:
        say("SPAN_INVALID", at, "the end lies beyond the start")


def _visual(v: dict, at: str, say: Report) -> None:
    if v.get("label") == "Contradicted":
        for k in ("contradicting_regions", "counter_evidence"):
            if not v.get(k):
                say("CONTRADICTION_UNSUPPORTED", f"{at}.{k}")


def _content(v: dict, at: str, say: Report) -> None:
    t, e = v.get("text"), v.get("excerpt")
    if isinstance(t, str):
        if isinstance(e, str) and e not in t:
            say("EXCERPT_NOT_SUBSTRING", f"{at}.excerpt")
        if isinstance(v.get("sha256"), str) and _HEX.fullmatch(v["sha256"]) and hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() != v["sha256"]:
            say("CONTENT_HASH_MISMATCH", f"{at}.sha256")
        if v.get("status") == "unavailable" and t:
            say("CONTENT_STATUS_INCONSISTENT", f"{at}.status")


def _target(v: dict, at: str, say: Report) -> None:
    t = v.get("target") if isinstance(v.get("target"), dict) else {}
    kind, asset, sha = t.get("kind"), t.get("asset_id"), t.get("text_sha256")
    if kind not in ("image", "claim_text", "ocr_text"):
        return
    image = kind == "image"
    if v.get("modality") is not None and v["modality"] != ("image" if image else "text"):
        say("FORENSIC_TARGET_MISMATCH", f"{at}.modality")
    good_asset = isinstance(asset, str) and re.fullmatch(FORMS["asset"], asset)
    good_sha = isinstance(sha, str) and _HEX.fullmatch(sha)
    if (not good_asset) if image else asset is not None:
        say("FORENSIC_TARGET_MISMATCH", f"{at}.target.asset_id")
    if sha is not None if image else not good_sha:
        say("FORENSIC_TARGET_MISMATCH", f"{at}.target.text_sha256")


def _scale(v: dict, at: str, say: Report) -> None:
    s = v.get("raw_scale") if isinstance(v.get("raw_scale"), dict) else None
    low, high, raw = _dig(s, "min"), _dig(s, "max"), v.get("raw_score")
    if _number(low) and _number(high):
        if not low < high:
            say("RAW_SCALE_INVALID", f"{at}.raw_scale")
        elif _number(raw) and not low <= raw <= high:
            say("RAW_SCORE_OUT_OF_SCALE", f"{at}.raw_score")
    if v.get("ai_generated_score") is not None and s is None:
        say("AI_SCORE_WITHOUT_SCALE", f"{at}.ai_generated_score")


def _accusation(v: dict, at: str, say: Report) -> None:
    status, verdict = v.get("status"), v.get("assessment")
    if not isinstance(status, str) or not isinstance(verdict, str):
        return
    idle = status in ("unsupported", "unavailable", "failed")
    if (idle and verdict != "not_assessed") or (status == "inconclusive" and verdict != "uncertain"):
        say("FORENSIC_STATUS_ASSESSMENT_MISMATCH", f"{at}.assessment")
    if idle and v.get("ai_generated_score") is not None:
        say("FORENSIC_STATUS_ASSESSMENT_MISMATCH", f"{at}.ai_generated_score")
    if status != "ok" and verdict == "likely_ai_generated":
        say("FORENSIC_ACCUSATION_WITHOUT_OK", f"{at}.assessment")


def _calibration(v: dict, at: str, say: Report) -> None:
    a = v.get("alpha")
    if _number(a) and not 0 < a < 1:
        say("ALPHA_INVALID", f"{at}.alpha")
    status = v.get("status")
    if status == "uncalibrated":
        wrong = [k for k in ("calibration_id", "alpha") if v.get(k) is not None] + (["sample_count"] if v.get("sample_count") not in (None, 0) else [])
    else:
        wrong = [k for k in ("calibration_id", "method", "alpha") if v.get(k) is None] if status in ("calibrated", "demo_only") else []
    for k in wrong:
        say("CALIBRATION_INCONSISTENT", f"{at}.{k}")


def _abstention(verdict: str) -> Callable[[dict, str, Report], None]:
    def rule(v: dict, at: str, say: Report) -> None:
        if v.get("abstention_flag") is True and v.get(verdict) not in (None, "InsufficientEvidence"):
            say("ABSTENTION_VERDICT_MISMATCH", f"{at}.{verdict}")

    return rule


def _label_set(v: object, at: str, say: Report) -> None:
    many(enum("fact"))(v, at, say)
    if isinstance(v, list) and len({str(x) for x in v}) < len(v):
        say("CONFIDENCE_SET_DUPLICATE", at)


# --- shapes ------------------------------------------------------------------

_some = text(False)
WARNING = record({"code": _some, "message": _some, "component": _some})
RUN = record({"run_id": text(False, "uuid"), "mode": enum("mode"), "started_at": instant, "finished_at": instant, "status": enum("run_status"), "versions": mapping(text()), "warnings": many(WARNING)})
MEDIA = record({"asset_id": text(False, "asset"), "sha256": digest, "media_type": _some, "width": whole(1), "height": whole(1), "uri": opt(_some)}, _media_id)
ATOM = record({
    "atom_id": text(False, "atom"), "statement": _some, "role": enum("role"), "subject": opt(text()), "predicate": opt(text()), "object": opt(text()),
    "qualifiers": record({"negated": opt(flag), "quantity": opt(text()), "time": opt(text()), "location": opt(text())}),
    "spans": many(record({"start": whole(), "end": whole()}, _span)), "depends_on": many(text(False, "atom")), "check_worthiness": opt(real(0, 1)), "parser_confidence": opt(real(0, 1)),
})
REGION = record({"region_id": text(False, "region"), "asset_id": text(False, "asset"), "bbox": box, "score": opt(real(0, 1)), "description": text()})
VISUAL = record({
    "atom_id": text(False, "atom"), "label": enum("visual"), "probabilities": probabilities("visual"), "observability_score": opt(real(0, 1)), "supporting_regions": many(REGION),
    "contradicting_regions": many(REGION), "counter_evidence": opt(text()), "rationale": opt(text()), "inference_kind": enum("inference"),
}, _visual)
ANALYSIS = record({"run": RUN, "atom_set_id": text(False, "atom_set"), "atomic_claims": many(ATOM), "visual_assessments": many(VISUAL), "ocr": many(record({"text": text(), "bbox": box, "confidence": opt(real(0, 1)), "language": opt(tag)}))})
EVIDENCE = record({
    "evidence_id": text(False, "evidence"), "atom_ids": many(text(False)),
    "source": record({"provider": _some, "kind": enum("kind"), "url": opt(_some), "title": text(), "publisher": opt(_some), "language": opt(tag), "published_at": opt(instant), "retrieved_at": instant}),
    "content": record({"text": text(), "excerpt": text(), "sha256": digest, "status": enum("content")}, _content),
    "provenance": record({
        "original_url": opt(_some), "archive_url": opt(_some), "first_seen_at": opt(instant), "captured_at": opt(instant), "date_basis": opt(_some), "discovery_method": _some,
        "duplicate_cluster_id": _some, "independence_group_id": _some, "temporal_eligible": opt(flag), "usage_note": opt(text()),
        "image_matches": many(record({"asset_id": text(False, "asset"), "matched_url": opt(_some), "match_type": enum("match"), "score": opt(real(0, 1))})),
    }),
    "relevance_score": real(0, 1), "credibility_score": opt(real(0, 1)), "rerank_score": opt(real()), "score_breakdown": mapping(real()),
})
SIGNAL = record({
    "signal_id": text(False, "signal"), "target": record({"kind": enum("target"), "asset_id": opt(text()), "text_sha256": opt(text())}), "modality": enum("modality"), "provider": _some,
    "model_version": opt(text()), "task": enum("task"), "status": enum("signal_status"), "raw_score": opt(real()), "raw_scale": opt(record({"min": real(), "max": real(), "higher_means_ai": flag})),
    "ai_generated_score": opt(real(0, 1)), "raw_label": opt(text()), "assessment": enum("assessment"), "calibration_status": enum("score_calibration"), "applicable_language": opt(tag),
    "limitations": many(text()), "analyzed_at": instant, "error_code": opt(_some),
}, _target, _scale, _accusation)
QUERY_LOG = record({"query_id": _some, "atom_ids": many(text(False)), "provider": _some, "query": text(), "duration_ms": whole(), "result_count": whole()})
PROVIDER = record({"provider": _some, "capability": enum("capability"), "status": enum("provider_status"), "message": opt(text())})
RETRIEVAL = record({"run": RUN, "atom_set_id": opt(text(False, "atom_set")), "evidence_list": many(EVIDENCE), "forensic_signals": many(SIGNAL), "query_log": many(QUERY_LOG), "provider_status": many(PROVIDER)})
CALIBRATION = record({
    "status": enum("calibration"), "calibration_id": opt(_some), "method": opt(_some), "alpha": opt(real()), "sample_count": opt(whole()), "group": opt(_some), "fallback_used": opt(_some), "validity_notes": many(text()),
}, _calibration)
LINK = record({"evidence_id": text(False, "evidence"), "atom_id": text(False, "atom"), "stance": enum("stance"), "quote": opt(text()), "rationale": opt(text())})
VERDICT = record({
    "atom_id": text(False), "base_label": enum("fact"), "status": enum("fact"), "probabilities": probabilities("fact"), "confidence_set": opt(_label_set), "abstention_flag": flag, "abstention_reasons": many(text()),
    "evidence_links": many(LINK), "visual_atom_ids": many(text(False)), "explanation": text(), "calibration": CALIBRATION,
}, _abstention("status"))
DECISION = record({
    "run": RUN, "atom_set_id": text(False), "atomic_verdicts": many(VERDICT), "base_label": enum("fact"), "final_verdict": enum("fact"), "probabilities": probabilities("fact"), "confidence_set": opt(_label_set),
    "abstention_flag": flag, "abstention_reasons": many(text()), "calibration": CALIBRATION,
    "decision_report": opt(record({"summary": text(), "key_findings": many(text()), "unresolved_questions": many(text()), "evidence_ids": many(text()), "forensic_signal_ids": many(text()), "limitations": many(text()), "suggested_next_steps": many(text()), "misinformation_category": opt(text())})),
    "human_review": opt(record({"reviewer": _some, "reviewed_at": instant, "verdict": enum("fact"), "reason": text()})),
}, _abstention("final_verdict"))
BUNDLE = record({
    "schema_version": _some, "case_id": text(False, "uuid"), "claim_revision": whole(1), "mode": enum("mode"), "created_at": instant,
    "input": record({"claim_text": text(), "language": tag, "image": opt(MEDIA), "as_of": opt(instant)}), "analysis": opt(ANALYSIS), "retrieval": opt(RETRIEVAL), "decision": opt(DECISION),
    "warnings": many(WARNING), "extensions": mapping(lambda v, at, say: None),
})


# --- rules that look across a whole bundle -----------------------------------


def _repeated(items: list[dict], key: str, code: str, at: str, say: Report) -> None:
    seen = set()
    for i, x in enumerate(items):
        k = x.get(key)
        if isinstance(k, str):
            if k in seen:
                say(code, f"{at}[{i}].{key}", k)
            seen.add(k)


def _references(ids: object, known: set[str], at: str, say: Report, analysed: bool) -> None:
    ids = [x for x in ids if isinstance(x, str)] if isinstance(ids, list) else []
    if ids and not analysed:
        say("ATOM_IDS_NOT_EMPTY", at, "no analysis to refer to")
    for x in dict.fromkeys(ids) if analysed else ():
        if x not in known:
            say("ATOM_REFERENCE_UNKNOWN", at, x)
    if len(set(ids)) < len(ids):
        say("ATOM_IDS_DUPLICATE", at)


def _dependencies(atoms: list[dict], at: str, say: Report) -> None:
    graph = {a["atom_id"]: [x for x in a.get("depends_on") or [] if isinstance(x, str)] for a in atoms if isinstance(a.get("atom_id"), str)}
    for a, needs in graph.items():
        for n in needs:
            if n not in graph:
                say("DEPENDENCY_DANGLING", at, f"{a} needs {n}")
            elif n == a:
                say("DEPENDENCY_CYCLIC", at, f"{a} needs itself")
    # Atoms whose needs are settled, or that no other needs, are taken away in turns; what stays is on cycles, told once a bundle.
    left = {a: {n for n in needs if n in graph} for a, needs in graph.items()}
    while off := [a for a, needs in left.items() if not needs & left.keys() or not any(a in others for others in left.values())]:
        for a in off:
            del left[a]
    if left:
        say("DEPENDENCY_CYCLIC", at, "among " + ", ".join(sorted(left)))


def _across(b: dict, say: Report) -> None:
    claim, analysis = _dig(b, "input", "claim_text"), _dig(b, "analysis")
    if isinstance(claim, str) and not claim.strip():
        say("CLAIM_TEXT_EMPTY", "$.input.claim_text")
    atoms = _items(b, "analysis", "atomic_claims")
    known = {a["atom_id"] for a in atoms if isinstance(a.get("atom_id"), str)}
    for section in ("analysis", "retrieval", "decision"):
        mode = _dig(b, section, "run", "mode")
        if mode is not None and mode != b.get("mode"):
            say("MODE_MISMATCH", f"$.{section}.run.mode")
    for i, a in enumerate(atoms):
        for j, s in enumerate(_items(a, "spans")):
            if isinstance(claim, str) and isinstance(s.get("end"), int) and s["end"] > len(claim):
                say("SPAN_OUT_OF_RANGE", f"$.analysis.atomic_claims[{i}].spans[{j}]")
    _repeated(atoms, "atom_id", "ATOM_ID_DUPLICATE", "$.analysis.atomic_claims", say)
    _dependencies(atoms, "$.analysis.atomic_claims", say)
    for i, v in enumerate(_items(b, "analysis", "visual_assessments")):
        if isinstance(v.get("atom_id"), str) and v["atom_id"] not in known:
            say("ATOM_REFERENCE_UNKNOWN", f"$.analysis.visual_assessments[{i}].atom_id", v["atom_id"])
    analysed, set_id = isinstance(analysis, dict), _dig(analysis, "atom_set_id")
    if analysed and isinstance(set_id, str) and isinstance(claim, str):
        try:
            want = atom_set_id(b)
        except (NotCanonical, KeyError, TypeError, AttributeError):
            want = set_id
        if want != set_id:
            say("ATOM_SET_ID_MISMATCH", "$.analysis.atom_set_id")
    if _dig(b, "decision") is not None and not analysed:
        say("INPUT_ANALYSIS_REQUIRED", "$.analysis")
    for section in ("retrieval", "decision"):
        own = _dig(b, section, "atom_set_id")
        if isinstance(_dig(b, section), dict) and own != (set_id if analysed else None) and (analysed or own is not None):
            say("ATOM_SET_MISMATCH", f"$.{section}.atom_set_id")
    evidence = _items(b, "retrieval", "evidence_list")
    _repeated(evidence, "evidence_id", "EVIDENCE_ID_DUPLICATE", "$.retrieval.evidence_list", say)
    _repeated(_items(b, "retrieval", "forensic_signals"), "signal_id", "SIGNAL_ID_DUPLICATE", "$.retrieval.forensic_signals", say)
    for name, rows in (("evidence_list", evidence), ("query_log", _items(b, "retrieval", "query_log"))):
        for i, x in enumerate(rows):
            _references(x.get("atom_ids"), known, f"$.retrieval.{name}[{i}].atom_ids", say, analysed)
    by_id = {e["evidence_id"]: e for e in evidence if isinstance(e.get("evidence_id"), str)}
    verdicts = _items(b, "decision", "atomic_verdicts")
    _repeated(verdicts, "atom_id", "ATOMIC_DECISION_DUPLICATE", "$.decision.atomic_verdicts", say)
    for i, v in enumerate(verdicts):
        at = f"$.decision.atomic_verdicts[{i}]"
        if isinstance(v.get("atom_id"), str) and v["atom_id"] not in known:
            say("ATOM_REFERENCE_UNKNOWN", f"{at}.atom_id", v["atom_id"])
        for j, link in enumerate(_items(v, "evidence_links")):
            to = f"{at}.evidence_links[{j}]"
            if link.get("evidence_id") not in by_id:
                say("EVIDENCE_REFERENCE_UNKNOWN", f"{to}.evidence_id")
            elif isinstance(link.get("quote"), str) and link["quote"] not in (_dig(by_id[link["evidence_id"]], "content", "text") or ""):
                say("QUOTE_NOT_SUBSTRING", f"{to}.quote")
            if link.get("atom_id") != v.get("atom_id"):
                say("EVIDENCE_LINK_ATOM_MISMATCH", f"{to}.atom_id")
    for x in _dig(b, "decision", "decision_report", "evidence_ids") or []:
        if x not in by_id:
            say("EVIDENCE_REFERENCE_UNKNOWN", "$.decision.decision_report.evidence_ids", str(x))


def atom_set_id(bundle: dict) -> str:
    """The id derived from the case, its claim and image and the canonical atoms (I16)."""
    claim = bundle["input"]["claim_text"]
    value = {
        "case_id": bundle["case_id"], "claim_revision": bundle["claim_revision"], "claim_text_sha256": hashlib.sha256(claim.encode()).hexdigest(),
        "image_sha256": _dig(bundle, "input", "image", "sha256"), "atomic_claims": canonical_atoms(bundle["analysis"]["atomic_claims"]),
    }
    return content_id("aset_", value)


def violations(data: str | None) -> list[tuple[str, str, str]]:
    """All broken rules of one bundle given as JSON text; an unsupported version is reported alone."""
    say = Report()
    try:
        b = parse_strict(data or "")
    except (ValueError, RecursionError) as e:
        return [("TYPE_MISMATCH", "$", f"no strict JSON: {e}"[:200])]
    if isinstance(b, dict) and isinstance(b.get("schema_version"), str) and b["schema_version"] != VERSION:
        return [("SCHEMA_VERSION_UNSUPPORTED", "$.schema_version", b["schema_version"])]
    BUNDLE(b, "$", say)
    if isinstance(b, dict):
        _across(b, say)
    return say.found


def primary_code(codes: list[str]) -> str | None:
    """The code a caller sees first."""
    for c in ("SCHEMA_VERSION_UNSUPPORTED", "INPUT_ANALYSIS_REQUIRED"):
        if c in codes:
            return c
    return "CONTRACT_VIOLATION" if codes else None


def validate(bundles: DataFrame, row_id: str, json_column: str) -> DataFrame:
    """`row_id, code, path, message`, a row per broken rule; valid bundles give none, null ones TYPE_MISMATCH."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *v) for i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for v in violations(data)]
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.column(0).type), *(pa.array(c, pa.string()) for c in cols[1:])], names=["row_id", "code", "path", "message"])

    narrow = bundles.select(F.col(row_id).alias("row_id"), F.col(json_column))
    return narrow.mapInArrow(scan, f"row_id {dict(narrow.dtypes)['row_id']}, code string, path string, message string")
