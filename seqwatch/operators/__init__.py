"""DataFrame -> DataFrame operators. Those in ``records``, ``scaling``,
``points`` and ``scoring`` hold for batch and stream alike."""
