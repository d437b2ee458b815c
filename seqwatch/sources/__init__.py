"""Where records, history and fitted parameters come from."""
