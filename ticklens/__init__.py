"""ticklens — trade analytics as Spark DataFrame operators.

Every operator is a function ``f(df, ...) -> DataFrame`` over the canonical
``trades`` (or ``ticks``) schema.  Nothing collects rows to the driver except
bounded samples / single-row parameters; order-dependent windows go through
:mod:`ticklens.plans.ordered` so no plan moves all rows into one task.
"""

__version__ = "0.1.0"
