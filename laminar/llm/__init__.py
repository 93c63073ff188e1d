"""Training-data operators over the text and vectors that accompany leaf records.

A *sidecar* is the text kept beside a picture: its segmentation metadata, run parameters and log.  Text operators take
tables with ``image_id`` and ``meta_text``.  Nothing outside this package imports it.
"""
