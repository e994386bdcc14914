"""Settings of the conversion jobs. Every default is the documented one."""

from __future__ import annotations

from dataclasses import dataclass, field

# Memory types, in the order of the data model.
MEMORY_TYPES = (
    "episodic",
    "semantic",
    "procedural",
    "affective",
    "prospective",
    "schematic",
)

# Every reason an input can be rejected for.
REJECTION_REASONS = (
    "type_excluded",
    "too_short",
    "chatter",
    "denied_tag",
    "low_salience",
    "not_prose",
    "unframeable",
    "dream_derived",
    "secret",
    "image_only",
    "empty_assistant",
    "session_zero",
    "spawn",
    "tool_result_too_long",
    "unparsable",
)

# Licence classes and instruction kinds.
LICENSE_CLASSES = ("open_reasoning", "closed_hidden", "answer_only")
INSTRUCTION_KINDS = ("templated_heading", "templated_tag", "llm_assisted", "lived_turn")

USED = "used"
PASS = "pass"


@dataclass(frozen=True)
class GateConfig:
    """Thresholds of the memory quality gate."""

    include_types: tuple[str, ...] = ("procedural", "semantic", "schematic")
    min_content: int = 120
    min_salience: float = 0.3
    denied_tags: tuple[str, ...] = ("a2a", "msg", "message", "test", "smoke", "chatter", "ping")
    include_dream_derived: bool = False
    min_word_bytes: int = 60

    def __post_init__(self) -> None:
        unknown = set(self.include_types) - set(MEMORY_TYPES)
        if unknown:
            raise ValueError(f"unknown memory type: {sorted(unknown)}")

    @staticmethod
    def parse_types(raw: list[str]) -> tuple[str, ...]:
        """Normalise user-supplied type names; an unknown one is an error."""
        return GateConfig(include_types=tuple(r.strip().lower() for r in raw)).include_types


@dataclass(frozen=True)
class ChunkConfig:
    """Sizes, in characters, that drive sectioning."""

    min_section: int = 120
    max_chunk: int = 6000
    max_title: int = 120


@dataclass(frozen=True)
class FrameConfig:
    """How a chunk is turned into a question."""

    domain: str | None = None
    max_tags: int = 3


@dataclass(frozen=True)
class ConvertConfig:
    gate: GateConfig = field(default_factory=GateConfig)
    chunk: ChunkConfig = field(default_factory=ChunkConfig)
    frame: FrameConfig = field(default_factory=FrameConfig)
    # Value of ``provenance.kind`` for examples that come from a memory.
    memory_kind: str = "memory"


@dataclass(frozen=True)
class HarvestConfig:
    """How session files are mined."""

    node_id: str | None = None
    max_tool_result_chars: int = 4000
    open_prefixes: tuple[str, ...] = ()
    # Reject rounds of closed models instead of keeping them without thinking.
    drop_closed: bool = False
    # Shortest hexadecimal run after ``token=`` or ``Bearer`` that counts as a key.
    min_token_hex: int = 64
