"""Regression kernels in NumPy for thousands of small fits inside grouped tasks.

A kernel is a function (task) -> predictor, and a predictor maps a matrix to
predictions on the task's working scale. `registry.KERNELS` lists them by name.
"""
