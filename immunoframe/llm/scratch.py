"""Intermediate tables in the folder that the driver and all executors share (see the core's module)."""

from ..sources.scratch import Scratch, whole_row

__all__ = ["Scratch", "whole_row"]
