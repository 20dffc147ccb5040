"""The dialect and its scalar functions."""
