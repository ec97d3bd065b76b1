"""A model that can be checked by hand: label i of a head scores ten times the share of the i-th letter."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

HEADS = {"sentiment": 5, "emotion": 28, "toxicity": 7}


def letters(**heads):
    def load():
        def model(texts):
            share = lambda t, i: 10.0 * t.count(chr(97 + i % 26)) / len(t)
            return {h: [[share(t, i) for i in range(n)] for t in texts] for h, n in heads.items()}

        return model

    return load
