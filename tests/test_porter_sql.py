"""The stemmer in SQL, the oracle of stemmed search, against the one in Python."""

import random

import duckdb

from tidepool.functions.stemming import normal
from tidepool.plans.porter import stems_sql


def test_stems_in_sql():
    rng = random.Random(1)
    words = "caresses ponies ties caress cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll yes yyy syzygy playing enjoyed naïve café über a is x9ing été".split()
    parts = ["tion", "ing", "ed", "s", "es", "ly", "al", "iz", "er", "at", "on", "y", "e", "ll", "th", "an", "é", "bl", "ement", "ous"]
    words += ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 5))) for _ in range(4000)]
    words = sorted(set(words))
    listed = ", ".join(f"('{w}')" for w in words)
    got = dict(duckdb.sql(f"WITH words(w) AS (VALUES {listed}), {stems_sql('words')} SELECT w, st FROM stems").fetchall())
    assert {w: got[w] for w in words} == {w: normal(w) for w in words}
