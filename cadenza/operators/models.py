"""Decision models for block switching: named column expressions, chosen by each stream.

A model says from a frame's windows whether it wants short blocks. `register` adds one; `decide` applies to each row the model that it names, so streams
with different models go through one plan. A name without a model raises when the row is reached; a null name takes the first model.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza.operators import decisions as D

#: A model: (steps: array of change and common energy, energies: array of a window's energy, quality: 1 is the default) -> boolean.
Model = Callable[[Column, Column, Column], Column]
#: Ratio of change to common energy that is a jump, and of the loudest window to the mean of all that is an attack.
JUMP, ATTACK = 3.0, 4.0
MODELS: dict[str, Model] = {}


def register(name: str) -> Callable[[Model], Model]:
    """Add a model under a name; a name that is taken raises."""

    def add(model: Model) -> Model:
        if name in MODELS:
            raise ValueError(f"there is a model {name}")
        MODELS[name] = model
        return model

    return add


@register("change")
def change(steps: Column, energies: Column, quality: Column) -> Column:
    """A step between neighbouring windows changes much more energy than they share."""
    least = F.greatest(quality, F.lit(D.LEAST_QUALITY))
    return F.exists(steps, lambda s: s["change"] * least > JUMP * s["common"])


@register("attack")
def attack(steps: Column, energies: Column, quality: Column) -> Column:
    """One window is much louder than the mean of all."""
    mean = F.aggregate(energies, F.lit(0.0), lambda s, e: s + e) / F.size(energies)
    return F.array_max(energies) > ATTACK * mean


def decide(model: Column, steps: Column, energies: Column, quality: Column | float = 1.0) -> Column:
    """Whether a frame wants short blocks, by the model that its row names."""
    quality, names = F.lit(quality), list(MODELS)
    out = F.when(F.coalesce(model, F.lit(names[0])) == names[0], MODELS[names[0]](steps, energies, quality))
    for name in names[1:]:
        out = out.when(model == name, MODELS[name](steps, energies, quality))
    return out.otherwise(F.raise_error(F.concat(F.lit("no model "), model)).cast("boolean"))
