"""phrasecast: phrase-occurrence analytics on Spark.

Four batch flows, each a chain of DataFrame -> DataFrame functions:

* ``plans.transcripts``  page text -> clean pages -> segments -> phrase labels
* ``plans.newsflow``     article dumps -> normalised articles -> per-event features
* ``plans.experiment``   labelled segments -> features -> folds -> models -> metrics
* ``plans.edge``         labels -> base rates with intervals -> market comparison
"""

__version__ = "0.1.0"
