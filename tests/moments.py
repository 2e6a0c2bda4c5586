"""The moment from which tests count minutes."""

from datetime import datetime

START = datetime(2024, 1, 1)
