"""corpusforge: text-corpus jobs (split, prompt, tokenise, score) on Spark DataFrames.

Every public operator takes DataFrames and returns a DataFrame; nothing is
collected to the driver except small, size-bounded control tables.
"""

from corpusforge.session import get_session, shared_dir

__all__ = ["get_session", "shared_dir"]
