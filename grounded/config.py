"""Job configuration (O37): plain dataclasses, validated on the driver.

Values become literals in the Spark plans; nothing here is shipped per row.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, asdict

# Fixed values that must agree with the reference's behaviour.
DEFAULT_VECTOR_SIZE = 768          # collection vector size, cosine distance
DEFAULT_SCORE_THRESHOLD = 0.3      # search score threshold
DEFAULT_BEAM = 200                 # approximate-search beam
DEFAULT_BLOCK_BYTES = 3000         # page packing flush size, in bytes
DEFAULT_WINDOW_TOKENS = 512        # token splitter chunk size
DEFAULT_WINDOW_OVERLAP = 100       # token splitter overlap
DEFAULT_CHAR_WINDOW = 800          # draft character splitter size
DEFAULT_CHAR_OVERLAP = 200         # draft character splitter overlap


@dataclass(frozen=True)
class TextConfig:
    block_bytes: int = DEFAULT_BLOCK_BYTES
    window_tokens: int = DEFAULT_WINDOW_TOKENS
    window_overlap: int = DEFAULT_WINDOW_OVERLAP
    char_window: int = DEFAULT_CHAR_WINDOW
    char_overlap: int = DEFAULT_CHAR_OVERLAP

    def validate(self) -> "TextConfig":
        if self.block_bytes <= 0:
            raise ValueError("block_bytes must be positive")
        if not 0 <= self.window_overlap < self.window_tokens:
            raise ValueError("need 0 <= window_overlap < window_tokens")
        if not 0 <= self.char_overlap < self.char_window:
            raise ValueError("need 0 <= char_overlap < char_window")
        return self


@dataclass(frozen=True)
class EmbedConfig:
    dim: int = DEFAULT_VECTOR_SIZE
    model: str = "standin-embedding"
    strip_newlines: bool = True

    def validate(self) -> "EmbedConfig":
        if self.dim <= 0:
            raise ValueError("dim must be positive")
        return self


@dataclass(frozen=True)
class SearchConfig:
    k: int | None = 10
    threshold: float | None = DEFAULT_SCORE_THRESHOLD
    exact: bool = False
    indexed_only: bool = False
    beam: int = DEFAULT_BEAM
    nprobe: int = 8
    exclude_self: bool = False
    # Broadcast bound for the question matrix, in bytes (float64 rows x dim).
    max_broadcast_bytes: int = 64 << 20
    # Scores are rounded before threshold and ranking so both engines agree.
    round_digits: int = 6

    def validate(self) -> "SearchConfig":
        if self.k is not None and self.k <= 0:
            raise ValueError("k must be positive or None")
        if self.nprobe <= 0:
            raise ValueError("nprobe must be positive")
        return self


@dataclass(frozen=True)
class AnswerConfig:
    main_model: str = "standin-main"
    main_temperature: float = 0.0
    input_guard_model: str = "standin-guard"
    output_guard_model: str | None = None   # defaults to the input guard
    input_temperature: float = 0.0
    output_temperature: float = 0.0
    guard_request_on_rag: bool = False        # the retrieval route has no request guard

    @property
    def effective_output_guard(self) -> str:
        return self.output_guard_model or self.input_guard_model


@dataclass(frozen=True)
class EngineConfig:
    collection: str = "rag"
    text: TextConfig = field(default_factory=TextConfig)
    embed: EmbedConfig = field(default_factory=EmbedConfig)
    search: SearchConfig = field(default_factory=SearchConfig)
    answer: AnswerConfig = field(default_factory=AnswerConfig)

    def validate(self) -> "EngineConfig":
        if not self.collection:
            raise ValueError("collection name must be non-empty")
        self.text.validate(); self.embed.validate(); self.search.validate()
        for t in (self.answer.main_temperature, self.answer.input_temperature,
                  self.answer.output_temperature):
            if not 0.0 <= t <= 2.0:
                raise ValueError("temperature out of range [0, 2]")
        return self

    @staticmethod
    def load(path: str, store_section: str = "vector_store") -> "EngineConfig":
        with open(path, encoding="utf-8") as fh:
            raw = json.load(fh)
        return EngineConfig.from_dict(raw, store_section)

    @staticmethod
    def from_dict(raw: dict, store_section: str = "vector_store") -> "EngineConfig":
        """``store_section`` names the section of the vector store's settings."""
        q = raw.get("query", {})
        ans = AnswerConfig(
            main_model=q.get("main_model_name", AnswerConfig.main_model),
            main_temperature=float(q.get("main_temperature", 0.0)),
            input_guard_model=q.get("input_guardrail_model_name", AnswerConfig.input_guard_model),
            output_guard_model=q.get("output_guardrail_model_name"),
            input_temperature=float(q.get("input_guardrail_temperature", 0.0)),
            output_temperature=float(q.get("output_guardrail_temperature", 0.0)),
        )
        store = raw.get(store_section, {})
        embed = EmbedConfig(model=raw.get("embedding", {}).get("model_name", EmbedConfig.model))
        return EngineConfig(collection=store.get("collection_name", "rag"), embed=embed, answer=ans).validate()

    def to_dict(self) -> dict:
        return asdict(self)
