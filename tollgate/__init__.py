"""tollgate: prepaid-charging analytics on Spark."""


def _pickle_by_value() -> None:
    """Ship the package's Python code inside the tasks that run it (the
    replay fold, the streaming processor), so executors need no installed
    copy of the package."""
    import sys
    try:
        from pyspark import cloudpickle
    except ImportError:
        return
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_pickle_by_value()
