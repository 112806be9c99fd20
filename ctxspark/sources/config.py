"""Experiment configuration on the driver: YAML with stages to flat options, names, validation."""

from __future__ import annotations

from dataclasses import dataclass

from ctxspark import constants as C


@dataclass(frozen=True)
class Shape:
    """What determines the shape of compressed sequences."""

    ratio: int = C.RATIO
    window: int = C.WINDOW
    overlap: int = C.OVERLAP
    pooling: str = "mean"
    adapter: str = "mlp"
    bidirectional: bool = True

    def __post_init__(self) -> None:
        if self.pooling not in {"eos", "mean", "concat"}:
            raise ValueError(f"pooling is one of eos, mean and concat, not {self.pooling}")
        if self.ratio < 1 or self.window % self.ratio:
            raise ValueError(f"the window {self.window} is no multiple of the ratio {self.ratio}")


def flat_options(config: dict, stage: str | None = None) -> dict[str, object]:
    """Options of all sections in one dictionary, those of a stage over them. Unknown stages raise a KeyError."""
    out: dict[str, object] = {}
    for name, section in config.items():
        if name != "stages" and isinstance(section, dict):
            out |= section
        elif name != "stages":
            out[name] = section
    if stage is not None:
        out |= config.get("stages", {})[stage] or {}
    return out


def to_argv(options: dict[str, object]) -> list[str]:
    """Command-line words of options: --name value, true as a bare flag, false and None left out, lists as several values."""
    out: list[str] = []
    for name, value in options.items():
        if value is None or value is False:
            continue
        out.append(f"--{name}")
        if value is not True:
            out += [str(v) for v in value] if isinstance(value, list) else [str(value)]
    return out


def load_yaml(path: str, stage: str | None = None) -> dict[str, object]:
    """The flat options of a YAML file."""
    import yaml

    with open(path, encoding="utf-8") as f:
        return flat_options(yaml.safe_load(f) or {}, stage)


def experiment_name(encoder: str, decoder: str, shape: Shape) -> str:
    """encoder-decoder-cs16-w1024-mean-mlp[-ov256][-causal], models by the last part of their names."""
    last = lambda m: m.rstrip("/").rpartition("/")[2]
    parts = [last(encoder), last(decoder), f"cs{shape.ratio}", f"w{shape.window}", shape.pooling, shape.adapter]
    parts += [f"ov{shape.overlap}"] if shape.overlap else []
    return "-".join(parts + ([] if shape.bidirectional else ["causal"]))


def short_name(model: str, keep: tuple[str, ...], last: tuple[str, ...]) -> str:
    """A model's name up to its size: the first part, parts that hold a word of ``keep``, and the first that holds one of ``last``."""
    parts = model.rstrip("/").rpartition("/")[2].split("-")
    out = parts[:1]
    for part in parts[1:]:
        if any(k in part for k in keep):
            out.append(part)
        elif any(k in part for k in last):
            return "-".join([*out, part])
    return "-".join(out)


def short_run_name(encoder: str, decoder: str) -> str:
    """Both models' short names: the encoder's ends with its size, the decoder's with its tuning."""
    return f"{short_name(encoder, ('Embedding', 'embedding'), ('B',))}-{short_name(decoder, ('B',), ('Instruct',))}"


def parse_betas(text: str) -> tuple[float, float]:
    """The two numbers of "0.9,0.999"."""
    parts = (text or "").split(",")
    try:
        one, two = map(float, parts)
    except ValueError as e:
        raise ValueError(f"two numbers with a comma are needed, not {text!r}") from e
    return one, two


def shard_sizes(n: int, ranks: int) -> tuple[int, int]:
    """How many of ``n`` elements each of the ranks holds, and how many of these places stay empty."""
    each = -(-n // ranks)
    return each, each * ranks - n
