"""Gates around data and analyses: contracts, configuration, registries, budgets, keys."""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterable
from dataclasses import dataclass, field
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywell.sources.files import TRACKS, TYPES, Held, check_track, claim, copies, digests, exists, held, inside, list_files, read_bytes, store, write_bytes


class GateError(RuntimeError):
    pass


def _utc(text: str) -> datetime:
    moment = datetime.fromisoformat(text)
    if moment.tzinfo is None:
        raise GateError(f"{text} has no time zone")
    return moment.astimezone(timezone.utc)


# -- source contracts ------------------------------------------------------

BREAKING = {"removed", "type_changed", "nullability_tightened"}


def contract_columns(spark: SparkSession, columns: Iterable[dict]) -> DataFrame:
    rows = [(c["name"], c["type"], bool(c.get("nullable", True))) for c in columns]
    if len({r[0] for r in rows}) < len(rows) or any(r[1] not in TYPES for r in rows):
        raise GateError("a contract's columns are distinct and of known types")
    return spark.createDataFrame(rows, "name string, type string, nullable boolean")


def contract_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """name, kind: a changed type hides a change of nullability; loosening is no change."""
    o = old.select("name", F.col("type").alias("old_type"), F.col("nullable").alias("old_null"))
    n = new.select("name", F.col("type").alias("new_type"), F.col("nullable").alias("new_null"))
    kind = (
        F.when(F.col("new_type").isNull(), "removed").when(F.col("old_type").isNull(), "added")
        .when(F.col("old_type") != F.col("new_type"), "type_changed").when(F.col("old_null") & ~F.col("new_null"), "nullability_tightened"))
    return o.join(n, "name", "full_outer").select("name", kind.alias("kind")).where(F.col("kind").isNotNull())


def gate_contract_change(spark: SparkSession, old: dict, new: dict, review: dict | None = None) -> list[dict]:
    """Changes between versions; breaking ones need an approved review two weeks ahead."""
    if old["source"] != new["source"]:
        raise GateError("contracts of two sources can't be compared")
    found = contract_changes(contract_columns(spark, old["columns"]), contract_columns(spark, new["columns"])).orderBy("name").collect()
    changes = [r.asDict() for r in found]
    if changes and new["version"] <= old["version"]:
        raise GateError("the version must rise")
    if any(c["kind"] in BREAKING for c in changes):
        if not review or review.get("decision") != "approved" or not review.get("review_id") or not review.get("reviewer"):
            raise GateError("a breaking change needs an approved review")
        takes_effect = _utc(review["effective_at"])
        if takes_effect < _utc(review["reviewed_at"]) + timedelta(days=14) or takes_effect != _utc(new["effective_at"]):
            raise GateError("a breaking change takes effect as reviewed, two weeks later at least")
    return changes


# -- configuration overlays ------------------------------------------------

SHARED, MIN_RETENTION_DAYS = "shared", 400


def flatten(tree: dict, prefix: str = "") -> dict:
    out = {}
    for k, v in tree.items():
        name = f"{prefix}.{k}" if prefix else k
        out |= flatten(v, name) if isinstance(v, dict) and v else {name: v}
    return out


def _kind(v) -> str:
    return "bool" if isinstance(v, bool) else "num" if isinstance(v, (int, float)) else type(v).__name__


def merge(base: dict, over: dict) -> dict:
    return base | {k: merge(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in over.items()}


def type_drift(base: dict, over: dict, path: str = "") -> list[str]:
    """Keys that an overlay gives another type; integers and floats are one, booleans their own."""
    out = []
    for k, v in over.items():
        if k not in base:
            continue
        name = f"{path}.{k}" if path else k
        if isinstance(v, dict) and isinstance(base[k], dict):
            out += type_drift(base[k], v, name)
        elif v is not None and _kind(v) != _kind(base[k]):
            out.append(name)
    return out


def overlay(base: dict, over: dict, track: str) -> dict:
    """The track's configuration; drift, changed shared keys and short retention raise."""
    check_track(track)
    days = ((base.get(SHARED) or {}).get("audit") or {}).get("retention_days", MIN_RETENTION_DAYS)
    if isinstance(days, bool) or not isinstance(days, int) or days < MIN_RETENTION_DAYS:
        raise GateError(f"audit retention is {MIN_RETENTION_DAYS} days at least")
    if drift := type_drift(base, over):
        raise GateError(f"types drift: {', '.join(drift)}")
    out = merge(base, over)
    before, after = flatten(base.get(SHARED) or {}), flatten(out.get(SHARED) or {})
    if bad := [k for k in before if after.get(k) != before[k]]:
        raise GateError(f"shared keys differ: {', '.join(bad)}")
    return out


def config_ledger(spark: SparkSession, base: dict, overlays: dict[str, dict]) -> DataFrame:
    """key, base, commerce, research, origin: who sets each key."""
    def rows(tree, name):
        return spark.createDataFrame([(k, json.dumps(v, ensure_ascii=False)) for k, v in flatten(tree).items()], f"key string, {name} string")

    d = rows(base, "base")
    for t in TRACKS:
        d = d.join(rows(overlays.get(t) or {}, t), "key", "full_outer")
    origin = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), c) for c in ("base", *TRACKS)]))
    return d.select("key", "base", *TRACKS, F.array_join(origin, "+").alias("origin"))


def config_diff(spark: SparkSession, before: dict, after: dict) -> DataFrame:
    def rows(tree, name):
        return spark.createDataFrame([(k, json.dumps(v, ensure_ascii=False)) for k, v in flatten(tree).items()], f"key string, {name} string")

    d = rows(before, "before").join(rows(after, "after"), "key", "full_outer")
    return d.where(~F.col("before").eqNullSafe(F.col("after")))


# -- append-only registries ------------------------------------------------

class JsonLedger:
    """Records by id in one JSON file; none is ever changed. Damage raises, and so does an id used again."""

    def __init__(self, uri: str, kind: str):
        self.uri, self.kind = uri, kind

    def load(self) -> dict:
        if not exists(self.uri):
            return {}
        try:
            raw = json.loads(read_bytes(self.uri))
            if raw["ledger"] != self.kind or not isinstance(raw["records"], dict):
                raise ValueError
        except (ValueError, KeyError, TypeError):
            raise GateError(f"{self.uri} is damaged") from None
        return raw["records"]

    def add(self, key: str, record: dict, test=None) -> None:
        """Record under a new id. ``test`` (of all records so far) may refuse; nobody else writes meanwhile."""
        try:
            with held(self.uri):
                self._add(key, record, test)
        except Held:
            raise GateError(f"{self.uri} is being written") from None

    def _add(self, key: str, record: dict, test) -> None:
        records = self.load()
        if key in records:
            raise GateError(f"{key} is recorded already")
        if test is not None:
            test(records)
        records[key] = record | {"recorded_at": datetime.now(timezone.utc).isoformat(timespec="seconds")}
        write_bytes(self.uri, json.dumps({"ledger": self.kind, "records": records}, ensure_ascii=False, indent=2).encode())


class BudgetExhausted(GateError):
    pass


@dataclass
class PrivacyBudget:
    """Epsilon spent against a total. Accounting only: no noise is added anywhere."""

    uri: str
    total: float = 1.0

    def __post_init__(self):
        if self.total <= 0:
            raise GateError("a budget is positive")
        self.ledger = JsonLedger(self.uri, "dp_budget")

    def spent(self) -> float:
        return sum(r["epsilon"] for r in self.ledger.load().values())

    def remaining(self) -> float:
        return self.total - self.spent()

    def spend(self, spend_id: str, epsilon: float, purpose: str = "") -> float:
        if epsilon < 0:
            raise GateError("an expense isn't negative")
        spent = 0.0

        def fits(records: dict) -> None:
            nonlocal spent
            spent = sum(r["epsilon"] for r in records.values())
            if spent + epsilon > self.total + 1e-9:
                raise BudgetExhausted(f"{spent} of {self.total} is spent; {epsilon} more is too much")

        self.ledger.add(spend_id, {"epsilon": float(epsilon), "purpose": purpose}, fits)
        return self.total - spent - epsilon


PLAN_FIELDS = ("outcome", "design", "method", "alpha", "mde", "power")


def plan_fingerprint(plan: dict) -> str:
    return hashlib.sha256(json.dumps(plan, sort_keys=True, ensure_ascii=False, default=str).encode()).hexdigest()


class Preregistry:
    """Plans before analyses: what runs must match what was registered, field by field."""

    def __init__(self, uri: str):
        self.ledger = JsonLedger(uri, "prereg")

    def register(self, plan_id: str, plan: dict) -> str:
        mark = plan_fingerprint(plan)
        self.ledger.add(plan_id, {"plan": plan, "fingerprint": mark})
        return mark

    def require(self, plan_id: str, executed: dict) -> dict:
        record = self.ledger.load().get(plan_id)
        if record is None:
            raise GateError(f"{plan_id} isn't registered")
        if plan_fingerprint(record["plan"]) != record["fingerprint"]:
            raise GateError(f"{plan_id} was changed after registration")
        differ = [f for f in PLAN_FIELDS if f not in executed or str(executed[f]) != str(record["plan"].get(f))]
        if differ:
            raise GateError(f"differs from the plan in {', '.join(differ)}")
        return record


def gate_dataset(manifest: dict, today: date | None = None) -> dict:
    """Name, version, owner, collection method, and an approval that holds today."""
    if missing := [k for k in ("dataset_name", "version", "owner", "collection_method") if not manifest.get(k)]:
        raise GateError(f"the manifest lacks {', '.join(missing)}")
    irb = manifest.get("irb")
    if not isinstance(irb, dict) or {"approved", "expires_at", "approval_no"} - set(irb):
        raise GateError("the manifest lacks a complete irb block")
    if irb["approved"] is not True:
        raise GateError("the study isn't approved")
    if date.fromisoformat(str(irb["expires_at"])) < (today or date.today()):
        raise GateError(f"the approval expired on {irb['expires_at']}")
    return {k: manifest[k] for k in ("dataset_name", "version", "owner", "collection_method", "irb")} | {"privacy": manifest.get("privacy") or {}}


ASSET_ID = re.compile(r"^[a-z0-9][a-z0-9._-]*$")


def asset_scope(answers: dict[str, bool], track: str | None = None) -> str:
    """Three questions: any yes needs a named track, and none makes the asset shared."""
    asked = {"depends_on_track_semantics", "failure_contaminates_other_track", "managed_data_flow"}
    if set(answers) != asked or not all(isinstance(v, bool) for v in answers.values()):
        raise GateError(f"answer yes or no to {', '.join(sorted(asked))}")
    if any(answers.values()) != (track is not None):
        raise GateError("an asset has a track if, and only if, any answer is yes")
    return check_track(track) if track else "shared"


class AssetRegistry:
    def __init__(self, uri: str):
        self.ledger = JsonLedger(uri, "assets")

    def register(self, asset_id: str, path: str, kind: str, rationale: str, answers: dict[str, bool], track: str | None = None) -> str:
        if not ASSET_ID.match(asset_id) or not path or path.startswith("/") or ".." in path.split("/") or not kind or not rationale:
            raise GateError("an asset has an id, a relative path, a kind and a reason")
        scope = asset_scope(answers, track)
        self.ledger.add(asset_id, {"path": path, "kind": kind, "rationale": rationale, "answers": answers, "scope": scope})
        return scope

    def by_scope(self, scope: str) -> list[str]:
        return sorted(k for k, v in self.ledger.load().items() if v["scope"] == scope)


# -- access ----------------------------------------------------------------

# What each level of agent may do.
LEVEL_ACTIONS = {"L1": {"read_via_semantic"}, "L2": {"read_via_semantic", "pipeline_rerun"}, "L3": {"read_via_semantic", "pipeline_rerun"}}


@dataclass
class Access:
    """Keys bound to actions, tracks and projects; every call is audited, refused ones too."""

    audit: object = None  # called with a dict
    keys: dict[str, dict] = field(default_factory=dict)

    def register(self, key: str, actions: set[str], tracks: set[str], projects: set[str] | None = None, level: str | None = None, expires_at: str | None = None) -> None:
        if not actions or not tracks or set(tracks) - set(TRACKS) or (level is not None and level not in LEVEL_ACTIONS):
            raise GateError("a key has actions, known tracks and a known level")
        self.keys[key] = {"actions": set(actions), "tracks": set(tracks), "projects": projects, "level": level, "expires_at": expires_at, "revoked": False}

    def revoke(self, key: str) -> None:
        if key in self.keys:
            self.keys[key]["revoked"] = True

    def _refusal(self, level, action, track, key, project) -> str:
        k = self.keys.get(key)
        if track not in TRACKS:
            return "unknown track"
        if action not in LEVEL_ACTIONS.get(level, ()):
            return "the level doesn't allow this action"
        if level == "L3" and track == "research":
            return "L3 never acts on research"
        if k is None:
            return "unknown key"
        if k["revoked"] or (k["expires_at"] and datetime.fromisoformat(k["expires_at"]) <= datetime.now(datetime.fromisoformat(k["expires_at"]).tzinfo)):
            return "the key is revoked or expired"
        if action not in k["actions"] or track not in k["tracks"] or (k["level"] and k["level"] != level):
            return "the key doesn't allow this"
        if k["projects"] is not None and project not in k["projects"]:
            return "the key isn't for this project"
        return ""

    def authorize(self, level: str, action: str, track: str, key: str | None, project: str | None = None) -> None:
        refusal = self._refusal(level, action, track, key, project)
        if self.audit:
            self.audit({"level": level, "action": action, "track": track, "key": key, "allowed": not refusal, "note": refusal})
        if refusal:
            raise PermissionError(refusal)


# -- backups, bridge, packages --------------------------------------------

def _manifest(folder: str) -> list[dict]:
    sizes = {n: s for n, s in list_files(folder) if n != "manifest.json"}
    found = digests(folder, list(sizes))
    return [{"path": n, "size": s, "sha256": found[n]} for n, s in sizes.items()]


def backup(volume: str, root: str, track: str) -> dict:
    """Copy a volume, with a manifest; never over another backup, never inside the volume."""
    check_track(track)
    if f"{root.rstrip('/')}/".startswith(f"{volume.rstrip('/')}/"):
        raise GateError("a backup lies outside its volume")
    name = f"bkp-{track}-{datetime.now(timezone.utc):%Y%m%dT%H%M%SZ}-{uuid.uuid4().hex[:8]}"
    target, files = f"{root.rstrip('/')}/{track}/{name}", _manifest(volume)
    copies(volume, target, [f["path"] for f in files])
    out = {"manifest_version": 1, "backup_id": name, "track": track, "files": files}
    write_bytes(f"{target}/manifest.json", json.dumps(out, indent=2).encode())
    return out | {"path": target}


def restore(backup_path: str, target: str, track: str) -> dict:
    """Into an absent or empty folder, after every file was checked."""
    out = json.loads(read_bytes(f"{backup_path}/manifest.json"))
    if out["track"] != track or out["manifest_version"] != 1:
        raise GateError("the backup is of another track or version")
    if list_files(target):
        raise GateError("a restore goes to an empty folder")
    if _manifest(backup_path) != out["files"]:
        raise GateError("the backup was changed")
    copies(backup_path, target, [f["path"] for f in out["files"]])
    return out


def drill(volume: str, root: str, scratch: str, track: str) -> bool:
    """Back up, restore, compare."""
    made = backup(volume, root, track)
    restore(made["path"], scratch, track)
    return _manifest(scratch) == made["files"]


class Bridge:
    """One-time, short-lived tokens that let one snapshot cross between tracks, audited on both sides."""

    def __init__(self, folder: str):
        self.folder = folder.rstrip("/")

    def issue(self, purpose: str, source: str, target: str, minutes: int = 15) -> str:
        if check_track(source) == check_track(target) or minutes <= 0:
            raise GateError("a token crosses from one track to the other, for some time")
        token = f"tk-{uuid.uuid4().hex}"
        row = {"purpose": purpose, "source": source, "target": target, "expires": (datetime.now(timezone.utc) + timedelta(minutes=minutes)).isoformat()}
        write_bytes(f"{self.folder}/tokens/{token}.json", json.dumps(row).encode())
        return token

    def redeem(self, token: str, purpose: str, source: str, target: str) -> None:
        path = f"{self.folder}/tokens/{token}.json"
        if not token or not re.match(r"^tk-[0-9a-f]{32}$", token) or not exists(path):
            raise GateError("no such token")
        row = json.loads(read_bytes(path))
        if _utc(row["expires"]) <= datetime.now(timezone.utc):
            raise GateError("the token expired")
        if (row["purpose"], row["source"], row["target"]) != (purpose, source, target):
            raise GateError("the token is for something else")
        if not claim(f"{path}.used"):
            raise GateError("the token was used")

    def export(self, token: str, purpose: str, source_root: str, target_root: str, source_track: str, target_track: str,
               source_ledger, target_ledger, run_id: str, claims: list[dict] | None = None) -> dict:
        """Redeem, verify, stage, import, audit: any failure leaves the target as it was."""
        from tallywell.sources.snapshots import manifest_hash, verify

        self.redeem(token, purpose, source_track, target_track)
        found = source_ledger.table("runs").where(F.col("run_id") == run_id).limit(1).collect()
        if not found or found[0]["track"] != source_track or not found[0]["snapshot_sha256"]:
            raise GateError("the run isn't in the source's ledger")
        run = found[0]
        if verify(source_root, run["snapshot_id"]) != run["snapshot_sha256"]:
            raise GateError("the snapshot isn't the one the run published")
        origin = f"{source_root.rstrip('/')}/snapshots/{run['snapshot_id']}"
        target = inside(target_root, f"{target_root.rstrip('/')}/imports/{run['snapshot_id']}")
        if exists(target):
            raise GateError("the snapshot was imported before")
        export_id = f"eb-{uuid.uuid4().hex[:12]}"
        try:
            copies(origin, target, [n for n, _ in list_files(origin)])
            if manifest_hash(target) != run["snapshot_sha256"]:
                raise GateError("the copy differs")
            out = {"export_id": export_id, "purpose": purpose, "run_id": run_id, "snapshot_id": run["snapshot_id"], "sha256": run["snapshot_sha256"], "claims": claims or []}
            write_bytes(f"{target}.manifest.json", json.dumps(out, ensure_ascii=False).encode())
            source_ledger.event("bridge", export_id, source_track, {"direction": "out", "to": target_track, "run_id": run_id})
            target_ledger.event("bridge", export_id, target_track, {"direction": "in", "from": source_track, "run_id": run_id})
        except Exception:
            s, path = store(target)
            if exists(target):
                s.delete_dir(path)
            raise
        return out | {"path": target}


def package(target: str, parts: dict[str, str], code: str = "") -> dict:
    """Collect files and folders of a run for reproduction, hashed."""
    if exists(f"{target}/manifest.json"):
        raise GateError("the package exists")
    for name, source in parts.items():
        folder, files = source, [n for n, _ in list_files(source)]
        if not files:
            folder, _, only = source.rpartition("/")
            files = [only]
        copies(folder, f"{target}/{name}", files)
    out = {"files": _manifest(target), "code": code}
    write_bytes(f"{target}/manifest.json", json.dumps(out, indent=2).encode())
    return out


def verify_package(target: str, code: str = "") -> list[str]:
    """Warnings; a file that is missing, added or changed raises."""
    out = json.loads(read_bytes(f"{target}/manifest.json"))
    if _manifest(target) != out["files"]:
        raise GateError("the package was changed")
    return [] if out["code"] == code else ["the code is of another version"]
