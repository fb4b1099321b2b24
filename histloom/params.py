"""Parameters of a run. Frozen dataclasses; operators turn them into literals in expressions."""

from __future__ import annotations

import dataclasses
import os
from dataclasses import dataclass, field
from datetime import date

TASKS = ("commit_message", "pr_review", "issue_to_patch", "all")
FORMATS = ("alpaca", "sharegpt")


@dataclass(frozen=True)
class FilterParams:
    # Names and defaults of parameter files.
    exclude_merge_commits: bool = True
    exclude_bot_authors: bool = True
    exclude_binary_only: bool = True
    exclude_revert_commits: bool = True
    exclude_wip_messages: bool = True
    min_commit_message_words: int = 5
    max_commit_message_chars: int = 2000
    min_diff_lines: int = 3
    max_diff_lines: int = 500
    min_files_changed: int = 1
    max_files_changed: int = 20
    min_content_score: float = 0.5
    min_alignment_score: float = 0.0
    require_verb_start: bool = True
    dedup_method: str = "minhash"
    dedup_threshold: float = 0.85
    min_pr_body_words: int = 20
    require_linked_issue: bool = False
    min_issue_to_patch_words: int = 20


@dataclass(frozen=True)
class CollectParams:
    # Fixed values, as above.
    max_commits_per_repo: int | None = 5000  # None: all
    max_prs_per_repo: int | None = 1000
    since: date | None = None
    branches: tuple[str, ...] = ()


@dataclass(frozen=True)
class RunParams:
    filter: FilterParams = field(default_factory=FilterParams)
    collect: CollectParams = field(default_factory=CollectParams)
    output_format: str = "alpaca"
    task: str = "all"

    def __post_init__(self):
        if self.task not in TASKS:
            raise ValueError(f"unknown task: {self.task}")
        if self.output_format not in FORMATS:
            raise ValueError(f"unknown output format: {self.output_format}")

    @property
    def wants_commits(self) -> bool:
        return self.task in ("all", "commit_message")

    @property
    def wants_reviews(self) -> bool:
        return self.task in ("all", "pr_review")

    @property
    def wants_patches(self) -> bool:
        return self.task in ("all", "issue_to_patch")

    def limited_to(self, n: int) -> "RunParams":
        """One limit for both newest commits and newest pull requests per repo."""
        collect = dataclasses.replace(self.collect, max_commits_per_repo=n, max_prs_per_repo=n)
        return dataclasses.replace(self, collect=collect)


# The three presets, as differences from the class defaults.
_PRESETS = {
    "default": RunParams(filter=FilterParams(min_alignment_score=0.15)),
    "strict": RunParams(
        filter=FilterParams(
            min_commit_message_words=7,
            max_commit_message_chars=1000,
            min_diff_lines=5,
            max_diff_lines=300,
            max_files_changed=10,
            min_content_score=0.7,
            min_alignment_score=0.25,
            dedup_threshold=0.80,
            min_pr_body_words=40,
            require_linked_issue=True,
            min_issue_to_patch_words=30,
        ),
        collect=CollectParams(
            max_commits_per_repo=1000, max_prs_per_repo=500, since=date(2022, 1, 1)
        ),
    ),
    "permissive": RunParams(
        filter=FilterParams(
            exclude_wip_messages=False,
            min_commit_message_words=4,
            max_commit_message_chars=1000,
            min_diff_lines=1,
            max_diff_lines=1000,
            max_files_changed=30,
            min_content_score=0.2,
            require_verb_start=False,
            dedup_method="exact",
            dedup_threshold=0.95,
            min_pr_body_words=5,
            min_issue_to_patch_words=0,
        ),
        collect=CollectParams(max_commits_per_repo=10000, max_prs_per_repo=2000),
    ),
}


def profile_names() -> tuple[str, ...]:
    return tuple(_PRESETS)


def profile(name: str) -> RunParams:
    if name not in _PRESETS:
        raise ValueError(f"unknown profile: {name}")
    return _PRESETS[name]


def from_mapping(data: dict) -> RunParams:
    """Class defaults overridden by a nested mapping with the keys of a parameter file."""
    collect = dict(data.get("collection") or {})
    if isinstance(collect.get("since"), str):
        collect["since"] = date.fromisoformat(collect["since"])
    collect["branches"] = tuple(collect.get("branches") or ())
    top = {k: data[k] for k in ("output_format", "task") if k in data}
    known = {f.name for f in dataclasses.fields(FilterParams)}
    chosen = {k: v for k, v in (data.get("filter") or {}).items() if k in known}
    known = {f.name for f in dataclasses.fields(CollectParams)}
    collect = {k: v for k, v in collect.items() if k in known}
    return RunParams(filter=FilterParams(**chosen), collect=CollectParams(**collect), **top)


def load_yaml(path: str) -> RunParams:
    if not os.path.exists(path):
        raise FileNotFoundError(f"no parameter file at {path}")
    import yaml

    with open(path, encoding="utf-8") as f:
        return from_mapping(yaml.safe_load(f) or {})


def dump_yaml(params: RunParams, path: str) -> None:
    import yaml

    collect = dataclasses.asdict(params.collect)
    collect["branches"] = list(params.collect.branches)
    collect["since"] = params.collect.since.isoformat() if params.collect.since else None
    data = {
        "filter": dataclasses.asdict(params.filter),
        "collection": collect,
        "output_format": params.output_format,
        "task": params.task,
    }
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        yaml.safe_dump(data, f, sort_keys=False)
