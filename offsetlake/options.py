"""Engine options: validated when made, with the defaults that results depend on."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace

SECRETS = ("password", "secret", "key.pem", "sasl.jaas.config")


def clean_choice(text: str, choices: tuple[str, ...]) -> str:
    """A choice without a trailing # comment and blanks; an error for anything else."""
    value = text.split("#", 1)[0].strip().lower()
    if value not in choices:
        raise ValueError(f"{value!r} is none of {choices}")
    return value


@dataclass(frozen=True)
class ExecutionOptions:
    max_in_flight: int = 1000
    max_retries: int = 3
    retry_backoff_ms: int = 1000
    exponential: bool = True
    max_retry_backoff_ms: int = 30000
    task_timeout_ms: int = 30000
    retry_jitter_ms: int = 200

    def __post_init__(self):
        for name in ("max_in_flight", "max_retries", "task_timeout_ms"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be 1 or more")
        if self.retry_jitter_ms < 0:
            raise ValueError("retry_jitter_ms must be 0 or more")


@dataclass(frozen=True)
class LogOptions:
    topic: str
    servers: str | list[str] = "localhost:9092"
    ordering: str = "key_hash"
    start: str = "earliest"
    poll_batch_size: int = 1000
    dlq_suffix: str = ".dlq"
    dlq_payload: str = "full"
    execution: ExecutionOptions = field(default_factory=ExecutionOptions)
    security: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if not re.fullmatch(r"[A-Za-z0-9._-]+", self.topic):
            raise ValueError(f"bad topic name {self.topic!r}")
        clean_choice(self.ordering, ("key_hash", "partition", "unordered"))
        clean_choice(self.start, ("earliest", "latest", "none"))
        clean_choice(self.dlq_payload, ("full", "metadata_only"))
        if self.poll_batch_size < 1:
            raise ValueError("poll_batch_size must be 1 or more")

    @property
    def bootstrap(self) -> str:
        parts = self.servers.split(",") if isinstance(self.servers, str) else self.servers
        return ",".join(p.strip() for p in parts if p.strip())

    def source(self, committed: dict[int, int] | None = None) -> dict[str, str]:
        """Options of Spark's Kafka source. committed: the next offset of each partition; where there is none, `start` says where to begin.

        Start none means that a partition without a commit is an error.
        """
        if self.start == "none" and not committed:
            raise ValueError(f"no committed offsets of {self.topic!r}, and start is none")
        start = json.dumps({self.topic: {str(p): o for p, o in sorted(committed.items())}}) if committed else self.start
        out = {"kafka.bootstrap.servers": self.bootstrap, "subscribe": self.topic, "startingOffsets": start, "failOnDataLoss": str(self.start == "none").lower(), "maxOffsetsPerTrigger": str(self.poll_batch_size)}
        return out | {f"kafka.{k.replace('_', '.')}": v for k, v in self.security.items() if v}

    def dlq_sink(self) -> dict[str, str]:
        """Options of Spark's Kafka sink for dead letters."""
        return {"kafka.bootstrap.servers": self.bootstrap, "includeHeaders": "true"} | {f"kafka.{k.replace('_', '.')}": v for k, v in self.security.items() if v}

    def public(self) -> dict[str, str]:
        """The source options without secrets."""
        return {k: v for k, v in replace(self, start="earliest").source().items() if not any(s in k for s in SECRETS)}
