"""An addition to the batch analyses: station pairs kept up to date as trips arrive."""
