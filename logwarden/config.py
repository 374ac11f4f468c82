"""Every tunable of the library in one immutable object."""

from __future__ import annotations

from dataclasses import dataclass

# Defaults, names and word lists that decide results.
SEVERITIES = ("none", "low", "medium", "high")
NON_IDENTITIES = ("unknown", "none", "n/a", "-", "?")
PRIVILEGE_KEYWORDS = (
    "command=/bin/su",
    "su root",
    "to group sudo",
    "to group wheel",
    "useradd",
    "adduser",
)
CONTAMINATION_SWEEP = (0.05, 0.10, 0.15, 0.20, 0.25)
NARRATED_SEVERITIES = ("high",)


@dataclass(frozen=True)
class Settings:
    # forest
    contamination: float = 0.20
    min_rows_per_user: int = 5
    seed: int = 42
    trees: int = 100
    subsample: int = 256
    vector_size: int = 384
    # severity: lowest negated score of a tier
    severity_high: float = 0.15
    severity_medium: float = 0.05
    # impossible travel
    travel_window_minutes: int = 60
    travel_prefix_octets: int = 2
    # incident grouping
    incident_window_minutes: int = 30
    # technique signal
    enumeration_signal_users: int = 3
    # span rules
    brute_force_window_minutes: int = 5
    brute_force_min_failures: int = 3
    enumeration_window_minutes: int = 10
    enumeration_min_users: int = 3
    # triage policy and prompts
    notable_min_events: int = 2
    prompt_max_events: int = 25
    prompt_sentences: str = "4-6"
    # camouflage
    spread_minutes: tuple[int, int] = (8, 20)
    slow_spread_minutes: tuple[int, int] = (35, 90)
    noise_ratio: float = 1.5
    volume_keep: float = 0.5
    # injection
    host: str = "server1"
    year: int = 2026
    days: int = 5
    instances_per_scenario: int = 3
    # physical limits; they choose a plan and never change a result
    broadcast_rows: int = 200_000     # a checked side up to here is broadcast
    broadcast_bytes: int = 32 << 20   # and up to this size of its compressed files
    heavy_key_rows: int = 5_000_000   # a join key above this is split
    chunk_hours: int = 24             # width of a time slice in span windows
    piece_lines: int = 1 << 20        # width of a line-number slice inside one second
    models_rows_per_task: int = 20_000


DEFAULTS = Settings()
