-- Reviewed orders (distinct) and negative share over their reviews, per purchase month.
SELECT format_string('%04d-%02d', year(o.purchase_ts), month(o.purchase_ts)) AS order_month,
       count(DISTINCT o.order_id) AS total_orders,
       avg(if(r.sentiment_label = 'Negative', 1D, 0D)) AS negative_sentiment_rate
FROM star_orders AS o JOIN star_reviews AS r USING (order_id)
WHERE o.purchase_ts IS NOT NULL
GROUP BY 1
ORDER BY 1
