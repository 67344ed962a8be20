import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))

from conftest_llm import docs, ledger, nothing  # noqa: E402, F401
