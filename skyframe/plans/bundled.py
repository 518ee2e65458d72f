"""Instruments and constellations over synthetic records, for trying things out; they register as any module's do."""

from __future__ import annotations

from skyframe.plans.instrument import Constellation, Instrument
from skyframe.sources import synthetic

FIRST_DAY, DAYS = "2009-01-01", 3

satellite = Instrument("skyframe", "satellite", lambda spark: synthetic.satellite(spark, FIRST_DAY, DAYS))
imager = Instrument("skyframe", "imager", lambda spark: synthetic.imager(spark, FIRST_DAY, DAYS))
model = Instrument("skyframe", "model", lambda spark: synthetic.model_grid(spark, FIRST_DAY))
nothing = Instrument("skyframe", "nothing", lambda spark: synthetic.satellite(spark, FIRST_DAY, 0))

single = Constellation((satellite,))
several = Constellation((satellite, imager, model))
empty = Constellation((nothing,))
partial = Constellation((satellite, nothing))
