"""Settings of generation runs, checked on the driver before any work begins."""

from __future__ import annotations

from dataclasses import dataclass

MODES = ("raw", "instruction_prefix")


def load_yaml(path: str) -> dict:
    """A mapping from a YAML file; anything else is an error."""
    import yaml

    with open(path, encoding="utf-8") as f:
        value = yaml.safe_load(f)
    if not isinstance(value, dict):
        raise ValueError(f"no mapping: {path}")
    return value


@dataclass(frozen=True)
class GenerationConfig:
    """What a run needs to know: models by key, prompts expected, repetitions, batches, seed, mode."""

    models: dict[str, dict]
    expected_prompts: int
    repetitions: int = 1
    batch_size: int = 8
    seed: int = 42
    mode: str = "raw"
    prefix: str | None = None

    def __post_init__(self):
        bad = [n for n in ("expected_prompts", "repetitions", "batch_size") if not isinstance(getattr(self, n), int) or isinstance(getattr(self, n), bool) or getattr(self, n) < 1]
        if not self.models or not all(isinstance(m, dict) and m.get("repo_id") for m in self.models.values()):
            bad.append("models")
        if self.mode not in MODES or bool(self.prefix and self.prefix.strip()) != (self.mode == "instruction_prefix"):
            bad.append("mode")
        if bad:
            raise ValueError(f"invalid: {', '.join(bad)}")

    @classmethod
    def from_dicts(cls, generation: dict, models: dict, keys: list[str] | None = None) -> GenerationConfig:
        """From the two files' contents, for some of the models or all."""
        missing = [s for s in ("experiment", "generation") if s not in generation] + ["models"] * ("models" not in models)
        if missing:
            raise ValueError(f"missing sections: {', '.join(missing)}")
        known = models["models"]
        unknown = [k for k in keys or () if k not in known]
        if unknown:
            raise ValueError(f"unknown models: {', '.join(unknown)}")
        e, g = generation["experiment"], generation["generation"]
        return cls({k: known[k] for k in (keys or known)}, e.get("expected_prompts"), e.get("repetitions", 1), g.get("batch_size", 8), g.get("seed", 42), e.get("prompt_mode", "raw"), e.get("prefix"))

    def check_count(self, found: int, limit: int | None = None) -> None:
        """The prompts found must be those expected, unless a limit was asked for."""
        if limit is None and found != self.expected_prompts:
            raise ValueError(f"{found} prompts, {self.expected_prompts} expected")
